"""One document per recording, written by a Python data source.

Spark deals the rows by recording and sorts them; each task streams them into files
of its own attempt.  Only the driver's commit gives the files their names, so a failed
or repeated task, or an aborted job, leaves nothing visible.  A task holds one batch of
rows, whatever the length of a recording.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from uuid import uuid4

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

ATTEMPTS = ".attempts"


@dataclass
class Written(WriterCommitMessage):
    """Files of a task: where they lie, and their final names."""

    files: list[tuple[str, str]]


class Writer(DataSourceArrowWriter):
    """Streams ``(vid, value)`` rows, sorted by recording; a null value only makes the document exist."""

    def __init__(self, options: dict[str, str]):
        self.path, self.name = options["path"], options["name"]
        self.head, self.between, self.tail = (options.get(k, "") for k in ("head", "between", "tail"))
        self.job = uuid4().hex

    def _store(self) -> tuple[fs.FileSystem, str]:
        path = re.sub(r"^file:/*", "/", self.path)
        return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")

    def write(self, iterator) -> Written:
        store, base = self._store()
        folder, files = f"{base}/{ATTEMPTS}/{self.job}/{uuid4().hex}", []
        vid, out, lines = None, None, 0

        def close() -> None:
            out.write(self.tail.encode())
            out.close()

        try:
            for batch in iterator:
                for key, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    if key != vid:
                        if out:
                            close()
                        if not files:
                            store.create_dir(folder, recursive=True)
                        vid, lines = key, 0
                        files.append((f"{folder}/{len(files)}", self.name.replace("{vid}", key)))
                        out = store.open_output_stream(files[-1][0])
                        out.write(self.head.encode())
                    if value is not None:
                        out.write((self.between * (lines > 0) + value).encode())
                        lines += 1
            if out:
                close()
        except BaseException:
            if out and not out.closed:
                out.close()
            raise
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        store, base = self._store()
        store.create_dir(base, recursive=True)
        new = {name: place for m in messages if m for place, name in m.files}
        ours = re.compile(re.escape(self.name).replace(re.escape("{vid}"), "[^/]+"))
        for old in store.get_file_info(fs.FileSelector(base)):
            if old.is_file and ours.fullmatch(old.base_name) and old.base_name not in new:
                store.delete_file(old.path)
        for name, place in new.items():
            store.move(place, f"{base}/{name}")
        self._clear(store, base)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*self._store())

    def _clear(self, store: fs.FileSystem, base: str) -> None:
        for folder in (f"{base}/{ATTEMPTS}/{self.job}", f"{base}/{ATTEMPTS}"):
            info = store.get_file_info(folder)
            last = folder.endswith(ATTEMPTS)
            if info.type == fs.FileType.Directory and not (last and store.get_file_info(fs.FileSelector(folder))):
                store.delete_dir(folder)


class RecordingFiles(DataSource):
    """``spark.write.format("recording_files")`` with options path, name (with ``{vid}``), head, between, tail."""

    @classmethod
    def name(cls) -> str:
        return "recording_files"

    def schema(self) -> str:
        return "vid string, value string"

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(dict(self.options))


def write_documents(
    rows: DataFrame, order: list[Column | str], value: Column, path: str, name: str,
    head: str = "", between: str = "", tail: str = "", vids: DataFrame | None = None,
) -> None:
    """Write ``value`` of the rows of each recording, in order, to ``<path>/<name>``.

    ``name`` holds ``{vid}``; a recording of ``vids`` without rows gets a document with
    head and tail only.  Documents of that name pattern from earlier writes are replaced as a whole.
    """
    spark = rows.sparkSession
    spark.dataSource.register(RecordingFiles)
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    x = rows.select(F.col("vid").cast("string").alias("vid"), F.struct(*keys).alias("o"), value.alias("value"))
    if vids is not None:
        x = x.unionByName(vids.select(F.col("vid").cast("string").alias("vid")).distinct(), allowMissingColumns=True)
    dealt = x.repartition("vid").sortWithinPartitions("vid", "o").select("vid", "value")
    dealt.write.format("recording_files").mode("append").options(path=path, name=name, head=head, between=between, tail=tail).save()
