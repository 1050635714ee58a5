"""Removal of repeated byte strings with suffix arrays.

A byte is removed if it is covered by a string of ``LENGTH`` bytes that also starts
anywhere else, in the same text or another.

1.  The *key* of a string is the least hash of the ``GRAM``-byte strings in it, so equal
    strings have equal keys.  One pass over the texts cuts each into *regions*: the
    maximal runs of starts with one key, some 190 starts long.
2.  Equal regions are added up (equal texts before that).  A region that occurs twice is
    repeated as a whole; a key with one region, once, holds no repeat.
3.  The different regions of all other keys are dealt by key to shards of about ``BLOCK``
    bytes.  Each shard's suffix array is induced (``suffix_sort``), and its permuted
    common prefixes show the starts whose strings occur again.
4.  A key with more than ``GROUP`` different regions (a passage set in many contexts) is not
    gathered: its strings are hashed to 128 bits each and counted, which combines on the map side.
5.  The spans of each text are united and cut out.

A text is known by 128 bits of its SHA-256.  Texts are moved once, to those of their
regions that count; texts with none are left out of all that follows.  Nothing is
broadcast or collected.  A task holds ``BLOCK`` bytes and one key's regions, whatever
the length of a text; a text itself is one value.

Defined results: null and empty texts have no bytes and no spans, and texts shorter than
``LENGTH`` lose nothing.  Rows are judged one by one: repeated rows are copies of each
other, null or repeated ids change nothing.  An empty table gives no rows.  Other columns
are not read, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import read, written
from .suffix_sort import repeated_starts, words_at

LENGTH = 400
GRAM = 16
#: bytes of regions in one suffix array, besides those of the last key
BLOCK = 2 << 20
#: starts worked on at once in the first pass
PIECE = 1 << 20
#: different regions of one key up to which they are sorted together
GROUP = 2048
REGION = "array<struct<key:bigint,start:bigint,size:bigint,digest:bigint,twice:boolean>>"


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes from each position on."""
    w = words_at(data)
    return _mixed(w[: len(data) - 15] * np.uint64(0x9E3779B97F4A7C15) + _mixed(w[8 : len(data) - 7]))


def least(values: np.ndarray, width: int) -> np.ndarray:
    """Least value of each run of ``width`` values."""
    n = len(values) - width + 1
    rows = -(-len(values) // width)
    grid = np.full(rows * width, np.iinfo(values.dtype).max, values.dtype)
    grid[: len(values)] = values
    grid = grid.reshape(rows, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def regions(data: np.ndarray, edges: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """``text, start, size, key, twice`` of all regions; text k lies at ``edges[k]`` to ``edges[k+1]``.

    ``twice`` is set where the gram that gives the key occurs again in the region.
    """
    width = length - GRAM + 1
    found: list[tuple] = []
    sizes = np.diff(edges)
    long = sizes >= length
    for a in range(0, max(int(edges[-1]) - length + 1, 0), PIECE):
        part = data[a : a + PIECE + length - 1]
        n = len(part) - length + 1
        hashes = gram_hashes(part)
        keys = least(hashes, width)
        step = np.zeros(n + 1, np.int64)
        for at, sign in ((edges[:-1][long], 1), (edges[1:][long] - length + 1, -1)):
            np.add.at(step, np.clip(at - a, 0, n), sign)
        valid = np.cumsum(step[:n]) > 0
        new = valid.copy()
        new[1:] &= (keys[1:] != keys[:-1]) | ~valid[:-1]
        stop = valid.copy()
        stop[:-1] &= (keys[1:] != keys[:-1]) | ~valid[1:]
        lo, hi = np.flatnonzero(new), np.flatnonzero(stop)
        if not len(lo):
            continue
        key = keys[lo]
        # grams that are the least of some string: the greatest key of the strings around them is their own hash
        around = np.full(n + 2 * (width - 1), np.iinfo(np.uint64).max, np.uint64)
        around[width - 1 : width - 1 + n] = ~keys
        chosen = np.flatnonzero(~least(around, width) == hashes)
        first, last = np.searchsorted(chosen, lo), np.searchsorted(chosen, hi + width)
        seen, k, live = np.zeros(len(lo), np.int64), 0, np.arange(len(lo))
        while len(live):
            live = live[first[live] + k < last[live]]
            seen[live] += hashes[chosen[first[live] + k]] == key[live]
            live, k = live[seen[live] < 2], k + 1
        text = np.searchsorted(edges, lo + a, side="right") - 1
        found.append((text, lo + a - edges[text], hi - lo + length, key, seen > 1))
    if not found:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, bool))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and edges of a binary column without nulls, not copied."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def _spans(rows: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """A list column of (start, end) pairs."""
    flat = np.concatenate([np.zeros((0, 2), np.int64), *rows])
    offsets = pa.array(np.cumsum([0, *map(len, rows)]), pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([flat[:, 0], flat[:, 1]], fields=[kind.value_type.field(0), kind.value_type.field(1)]))


def _united(spans: np.ndarray) -> np.ndarray:
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    first = np.r_[True, spans[1:, 0] > reach[:-1]]
    return np.stack([spans[first, 0], reach[np.r_[np.flatnonzero(first)[1:] - 1, len(spans) - 1]]], axis=1)


def cut_texts(docs: DataFrame, length: int) -> DataFrame:
    """``id, print, sha256, n_bytes, regions`` of each row of ``id, print, data``; the data stay behind."""
    out = T.StructType([docs.schema["id"], *T.StructType.fromDDL(f"print binary, sha256 string, n_bytes bigint, regions {REGION}").fields])
    kind = to_arrow_type(out["regions"].dataType)
    parts = [kind.value_type.field(i) for i in range(kind.value_type.num_fields)]

    def run(batches):
        for b in batches:
            data, edges = _flat(b.column(2))
            text, start, size, key, twice = regions(data, edges, length)
            at = edges[text] + start
            whole = memoryview(data)
            digest = np.frombuffer(b"".join(hashlib.blake2b(whole[i:j], digest_size=8).digest() for i, j in zip(at.tolist(), (at + size).tolist(), strict=True)), np.int64)
            offsets = pa.array(np.searchsorted(text, np.arange(len(edges))), pa.int32())
            columns = [pa.array(c, f.type) for c, f in zip((key.view(np.int64), start, size, digest, twice), parts, strict=True)]
            sha = pa.array([hashlib.sha256(whole[i:j]).hexdigest() for i, j in zip(edges.tolist(), edges[1:].tolist(), strict=False)], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), sha, pa.array(np.diff(edges)), pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(columns, fields=parts))], out.names)

    return docs.mapInArrow(run, out)


def sorted_shards(parts: DataFrame, length: int, block: int) -> DataFrame:
    """``print, start, spans``: repeated strings of the regions ``key, digest, data`` that lie in one partition by key."""
    out = T.StructType.fromDDL("print binary, start bigint, spans array<struct<lo:bigint,hi:bigint>>")
    kind = to_arrow_type(out["spans"].dataType)

    def shard(rows):
        sizes = np.array([len(r[4]) for r in rows])
        mark = repeated_starts(np.frombuffer(b"".join(r[4] for r in rows), np.uint8), sizes, length)
        edge = np.flatnonzero(np.diff(np.r_[False, mark, False].astype(np.int8)))
        lo, hi = edge[::2], edge[1::2] + length - 1
        ends = np.cumsum(sizes)
        whose = np.searchsorted(ends, lo, side="right")
        spans = np.stack([lo, hi], axis=1) - (ends - sizes)[whose][:, None]
        cuts = np.searchsorted(whose, np.arange(len(rows) + 1))
        hit = np.flatnonzero(np.diff(cuts))
        return pa.RecordBatch.from_arrays([pa.array([rows[k][2] for k in hit], pa.binary()), pa.array([rows[k][3] for k in hit], pa.int64()), _spans([spans[cuts[k] : cuts[k + 1]] for k in hit], kind)], out.names)

    def run(batches):
        rows, total, last = [], 0, None
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if row[:2] == last:
                    continue
                if total >= block and row[0] != last[0]:
                    yield shard(rows)
                    rows, total = [], 0
                last = row[:2]
                rows.append(row)
                total += len(row[4])
        if rows:
            yield shard(rows)

    return parts.select("key", "digest", "print", "start", "data").repartition("key").sortWithinPartitions("key", "digest").mapInArrow(run, out)


def counted_strings(parts: DataFrame, length: int) -> DataFrame:
    """As ``sorted_shards``, for keys with too many regions: every string is hashed and counted."""

    def run(batches):
        for b in batches:
            for key, name, start, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                h = np.frombuffer(b"".join(hashlib.blake2b(data[i : i + length], digest_size=16).digest() for i in range(len(data) - length + 1)), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([name] * (len(h) // 2), pa.binary()), pa.array(start + np.arange(len(h) // 2)), pa.array(h[::2]), pa.array(h[1::2])], ["print", "at", "a", "b"])

    each = parts.select("key", "print", "start", "data").mapInArrow(run, "print binary, at bigint, a bigint, b bigint")
    again = each.groupBy("a", "b").agg(F.count("*").alias("n")).where("n > 1").select("a", "b")
    return each.join(again, ["a", "b"], "left_semi").select("print", F.col("at").alias("start"), F.expr(f"array(struct(0L as lo, {length}L as hi))").alias("spans"))


def repeats(docs: DataFrame, ident: str = "doc_id", text: str = "text", length: int = LENGTH, block: int = BLOCK, group: int = GROUP) -> tuple[DataFrame, DataFrame]:
    """Rows and the different texts that lose bytes.

    ``id, print, sha256, n_bytes`` for each row, ``print, spans, kept`` for each text with
    removed bytes: spans are its maximal removed runs (start, end), kept the remaining bytes.
    """
    data = F.coalesce(F.col(f"`{text}`").cast("string").cast("binary"), F.lit(b""))
    src = docs.select(F.col(f"`{ident}`").alias("id"), data.alias("data")).select("id", F.unhex(F.substring(F.sha2("data", 256), 1, 32)).alias("print"), "data")
    rows = written(cut_texts(src, length))
    texts = rows.where(f"n_bytes >= {length}").groupBy("print").agg(F.min(F.struct("id")).alias("one"), F.count("*").alias("copies"), F.first("n_bytes").alias("n_bytes"), F.first("regions").alias("regions"))
    texts = written(texts.select("print", "one.id", "copies", "n_bytes", "regions"))
    each = texts.select("print", "id", "copies", F.explode("regions").alias("r")).select("print", "id", "copies", "r.*")
    kinds = written(each.groupBy("key", "digest").agg(F.count("*").alias("n"), F.max("twice").alias("twice"), F.min(F.struct("print", "id", "start", "size", "copies")).alias("one")))
    keys = kinds.groupBy("key").agg(F.sum(F.col("n") + F.col("twice").cast("int")).alias("total"), F.count("*").alias("kinds"), F.max("twice").alias("any"))
    compared = kinds.join(keys.where("total > 1 and (kinds > 1 or any)").select("key", "kinds"), "key")
    compared = compared.select("one.print", "one.id", "one.copies", F.struct("key", "digest", "kinds", "one.start", "one.size").alias("part"))
    whole = each.where("copies = 1").join(kinds.where("n > 1").select("key", "digest"), ["key", "digest"], "left_semi").select("print", "id", "copies", F.struct(F.col("start").alias("lo"), (F.col("start") + F.col("size")).alias("hi")).alias("span"))
    needed = compared.unionByName(whole, allowMissingColumns=True).groupBy("print", "id").agg(F.max("copies").alias("copies"), F.collect_list("part").alias("parts"), F.collect_list("span").alias("spans"))
    needed = needed.withColumnsRenamed({"print": "print_", "id": "id_"})
    near = written(src.join(needed, F.expr("print = print_ and id <=> id_")).select("print", "data", "copies", "parts", "spans"))
    parts = near.select("print", "data", F.explode("parts").alias("p")).select("print", "p.key", "p.digest", "p.kinds", "p.start", F.expr("substring(data, int(p.start + 1), int(p.size))").alias("data"))
    found = sorted_shards(parts.where(F.col("kinds") <= group), length, block).unionByName(counted_strings(parts.where(F.col("kinds") > group).dropDuplicates(["key", "digest"]), length))
    found = found.groupBy("print").agg(F.flatten(F.collect_list(F.transform("spans", lambda x: F.struct((F.col("start") + x["lo"]).alias("lo"), (F.col("start") + x["hi"]).alias("hi"))))).alias("found"))
    partly = near.where("copies = 1").select("print", "data", "spans").join(found, "print", "left")
    partly = partly.select("print", "data", F.concat("spans", F.coalesce("found", F.expr("cast(array() as array<struct<lo:bigint,hi:bigint>>)"))).alias("spans")).where("size(spans) > 0")
    copied = texts.where("copies > 1").select("print", F.expr("array(struct(0L as lo, n_bytes as hi))").alias("spans"), F.lit(b"").alias("kept"))
    return rows.select("id", "print", "sha256", "n_bytes"), cut_out(partly).unionByName(copied)


def cut_out(texts: DataFrame) -> DataFrame:
    """``print, spans, kept`` of ``print, data, spans``: spans united, and the bytes outside."""
    out = T.StructType.fromDDL("print binary, spans array<struct<lo:bigint,hi:bigint>>, kept binary")
    kind = to_arrow_type(out["spans"].dataType)

    def run(batches):
        for b in batches:
            spans, kept = [], []
            offsets, pairs = b.column(2).offsets.to_numpy(), b.column(2).values
            lohi = np.stack([pairs.field(0).to_numpy(), pairs.field(1).to_numpy()], axis=1)
            for k, data in enumerate(b.column(1).to_pylist()):
                own = _united(lohi[offsets[k] : offsets[k + 1]])
                spans.append(own)
                kept.append(b"".join(data[i:j] for i, j in zip([0, *own[:, 1].tolist()], [*own[:, 0].tolist(), len(data)], strict=True)))
            yield pa.RecordBatch.from_arrays([b.column(0), _spans(spans, kind), pa.array(kept, pa.binary())], out.names)

    return texts.mapInArrow(run, out)


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, texts = repeats(read(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["hi"] - s["lo"])
    digest = written(texts.select("print", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")))
    zero = F.lit(0).cast("long")
    # a text that loses nothing keeps the digest of its first pass
    return rows.join(digest, "print", "left").select(
        F.col("id").alias("doc_id"), "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("kept_sha256", "sha256").alias("kept_sha256")
    )
