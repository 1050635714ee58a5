"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager
from uuid import uuid4
from weakref import WeakKeyDictionary

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

#: a word is a run of characters other than the six ASCII white-space characters
WORD = r"[^\x20\x09-\x0D]+"
#: bytes of text handled in Python at once
SLICE = 4 << 20
#: folders of the tables that ``written`` has returned
_FOLDERS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors and the driver share.

    ``spark.checkpoint.dir`` names it.  A temporary folder stands in only in
    local mode, where one machine runs everything; elsewhere the setting is required.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if folder is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


def saved(df: DataFrame) -> DataFrame:
    """Write an intermediate table once to the shared folder, so that several steps read it and a lost executor loses nothing."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """DataFrames built inside leave no shuffle files behind when an action on them ends.

    Otherwise they stay until the driver collects its garbage, and the steps of a long job add up.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def written(df: DataFrame) -> DataFrame:
    """Like ``saved``, as a Parquet table of the shared folder, until it is ``released``.

    For steps that repeat: a checkpointed plan hands its constraints on, and they
    multiply with every join of a loop until they fill the driver.
    """
    folder = f"{shared_folder(df.sparkSession).rstrip('/')}/table-{uuid4().hex}"
    with shuffles_removed(df.sparkSession):
        df.write.parquet(folder)
    out = df.sparkSession.read.schema(df.schema).parquet(folder)
    _FOLDERS[out] = folder
    return out


def released(*tables: DataFrame) -> None:
    """Remove the files of ``written`` tables that no step reads any more; other tables are left alone."""
    for df in tables:
        if folder := _FOLDERS.pop(df, None):
            spark = df.sparkSession
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def bounded(df: DataFrame, rows: int = 10_000) -> DataFrame:
    """Hint a broadcast only if the saved table is counted to have at most so many rows; otherwise adaptive execution chooses the join."""
    return F.broadcast(df) if df.count() <= rows else df


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def numbered(words: list[bytes]) -> dict[bytes, int]:
    """The different words in order of appearance, with their numbers."""
    different = dict.fromkeys(words)
    return dict(zip(different, range(len(different)), strict=True))


def by_bytes(column: pa.Array, most: int = SLICE) -> list[tuple[int, int]]:
    """Cut a binary column into runs of rows of about so many bytes, one row at least."""
    if not len(column):
        return []
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    part = (offsets[:-1] - offsets[0]) // most
    edges = np.flatnonzero(np.diff(part, prepend=-1)).tolist()
    return list(zip(edges, [*edges[1:], len(column)], strict=True))


def scan(df: DataFrame, make, out_ddl: str, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Run Python once over a text column; the other columns travel along as struct ``row``.

    ``make()`` is called once per task and returns a function from a list of texts
    (bytes in UTF-8, or None) to one list per output column.  ``carry`` names the
    columns to keep (default: all).  Texts become Python objects ``SLICE`` bytes at a time.
    """
    keep = [F.struct("*")] if carry is None else [F.struct(*[F.col(f"`{c}`") for c in carry])]
    src = df.select(keep[0].alias("row"), F.col(f"`{text}`").cast("string").cast("binary").alias("_text"))
    out = T.StructType([src.schema["row"], *T.StructType.fromDDL(out_ddl).fields])
    types = [to_arrow_type(f.dataType) for f in out.fields[1:]]
    names = [f.name for f in out.fields]

    def run(batches):
        work = make()
        for b in batches:
            for lo, hi in by_bytes(b.column(1)):
                cols = work(b.column(1)[lo:hi].to_pylist())
                yield pa.RecordBatch.from_arrays([b.column(0)[lo:hi], *[pa.array(c, t) for c, t in zip(cols, types, strict=True)]], names)
        pa.default_memory_pool().release_unused()  # the worker stays for other stages

    return src.mapInArrow(run, out)
