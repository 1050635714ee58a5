"""Training-order materialisation of token ids.

Each document is tokenised, closed by an end token and cut into sequences of
``SEQUENCE`` ids, the last one padded with end tokens, so every sequence is a
record of the same number of bytes.  The ids are written once to the shared folder,
which fixes their partitions.  Sequences are numbered 0 to N-1 in that order: they
are counted per partition, and numbering adds the partition's offset.  A keyed
Feistel network over the next even power of two, walked until it falls below N,
permutes the numbers; the image is the global slot.  Slots are dealt to contiguous
ranges, a range partition each, and sorted, so a partition holds whole shards of
``SHARD`` records in training order.  Record ``slot`` starts at byte
``slot % SHARD * stride`` of shard ``slot // SHARD``: a reader resumes at any slot.
A lost executor's partitions are numbered again from the same written ids.

The vocabulary file is read by the driver and sent to the tasks (its size is fixed).

Defined results: null and empty texts give no sequence; repeated rows are separate
documents; no documents give no rows; a null doc_id stays null.
"""

from __future__ import annotations

import base64
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import by_bytes, read, saved

SEQUENCE = 512
SHARD = 16_384
ROUNDS = 6
KEY = 20_240_229
#: encoded pieces kept per Python worker
CACHE = 200_000
_LOADED: dict = {}


class Pieces(dict):
    """Token ids, as bytes, of the pieces between single blanks; filled on demand."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import tiktoken

        super().__init__()
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.kind = np.uint16 if len(ranks) < 1 << 16 else np.uint32
        self.end = len(ranks)

    def raw(self, text: str) -> bytes:
        return np.array(self.encoding.encode_ordinary(text), self.kind).tobytes()

    def __missing__(self, piece: str) -> bytes:
        if len(self) > CACHE:
            self.clear()
        got = self[piece] = self.raw(" " + piece)
        return got

    #: a blank with white space on both sides (or at the end) may merge across the cut
    UNSAFE = re.compile(r"\s (?:\s|$)")

    def encode(self, text: str) -> bytes:
        """Ids of a text.  The pattern starts a new piece at a blank, so pieces may be encoded apart."""
        if self.UNSAFE.search(text):
            return self.raw(text)
        first, *rest = text.split(" ")
        return self.raw(first) + b"".join(map(self.__getitem__, rest))


def vocabulary(path: str | None = None, pattern: str | None = None) -> tuple[dict[bytes, int], str]:
    """Ranks and split pattern; by default those of the installed public 50k byte-level vocabulary."""
    if path is None or pattern is None:
        import public_tokenizers

        path, pattern = path or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern


def feistel(x: np.ndarray, n: int, key: int = KEY, rounds: int = ROUNDS) -> np.ndarray:
    """Keyed permutation of 0..n-1, applied to each element."""
    half = np.uint64(max(1, (max(n - 1, 1).bit_length() + 1) // 2))
    mask = np.uint64((1 << int(half)) - 1)

    def once(v):
        a, b = v >> half, v & mask
        for r in range(rounds):
            m = (b + np.uint64((key * 0x9E3779B97F4A7C15 + r * 0xD1B54A32D192ED03) % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
            m = (m ^ (m >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            a, b = b, a ^ ((m >> np.uint64(31)) & mask)
        return (a << half) | b

    out = once(x.astype(np.uint64))
    while (far := out >= np.uint64(n)).any():
        out[far] = once(out[far])
    return out.astype(np.int64)


def _pieces(vocab) -> Pieces:
    ranks, pattern = vocab.value
    name = (len(ranks), pattern, hash(frozenset(list(ranks.items())[-200:])))
    if name not in _LOADED:  # kept by the Python worker for its next tasks
        _LOADED.clear()
        _LOADED[name] = Pieces(ranks, pattern)
    return _LOADED[name]


def encoded(src: DataFrame, vocab) -> DataFrame:
    """``doc_id, ids`` of the documents with text; the ids are bytes, closed by the end token."""
    out = T.StructType([src.schema["doc_id"], T.StructField("ids", T.BinaryType())])

    def run(batches):
        pieces = _pieces(vocab)
        end = np.array([pieces.end], pieces.kind).tobytes()
        for b in batches:
            b = b.filter(pc.fill_null(pc.greater(pc.binary_length(b.column(1)), 0), False))
            for lo, hi in by_bytes(b.column(1)):
                yield pa.RecordBatch.from_arrays([b.column(0)[lo:hi], pa.array([pieces.encode(t) + end for t in b.column(1)[lo:hi].to_pylist()], pa.binary())], out.names)
        pa.default_memory_pool().release_unused()

    return src.mapInArrow(run, out)


def training_order(docs: DataFrame, ident: str = "doc_id", text: str = "text", vocab: tuple[dict[bytes, int], str] | None = None, length: int = SEQUENCE, shard: int = SHARD, key: int = KEY) -> DataFrame:
    """One row per record in training order: slot, shard, offset, doc_id, part, n_tokens, tokens.

    ``tokens`` are little-endian ids of fixed width, ``part`` numbers the records of a document.
    """
    sc = docs.sparkSession.sparkContext
    src = docs.select(F.col(f"`{ident}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    vocab = vocabulary() if vocab is None else vocab
    kind = np.uint16 if len(vocab[0]) < 1 << 16 else np.uint32
    width = np.dtype(kind).itemsize
    end, stride = np.array([len(vocab[0])], kind).tobytes(), length * width
    kept = saved(encoded(src, sc.broadcast(vocab)))
    counts = kept.groupBy(F.spark_partition_id().alias("part")).agg(F.sum(F.ceil(F.octet_length("ids") / F.lit(stride))).alias("n")).collect()  # one row per partition
    start, total = {}, 0
    for r in sorted(counts):
        start[r["part"]], total = total, total + r["n"]
    plan = sc.broadcast(start)
    out = T.StructType([T.StructField("slot", T.LongType()), src.schema["doc_id"], *T.StructType.fromDDL("part int, n_tokens int, tokens binary").fields])
    kinds = [to_arrow_type(f.dataType) for f in out.fields]

    def number(batches):
        at = plan.value.get(TaskContext.get().partitionId(), 0)
        for b in batches:
            who, part, size, data = [], [], [], []
            for k, ids in enumerate(b.column(1).to_pylist()):
                n = len(ids) // width
                records = -(-n // length)
                ids += end * (records * length - n)
                who += [k] * records
                part += range(records)
                size += [length] * (records - 1) + [n - length * (records - 1)]
                data += [ids[i : i + stride] for i in range(0, len(ids), stride)]
            slots = feistel(np.arange(at, at + len(who)), total, key) if who else np.zeros(0, np.int64)
            at += len(who)
            yield pa.RecordBatch.from_arrays([pa.array(slots), b.column(0).take(pa.array(who, pa.int64())), pa.array(part, kinds[2]), pa.array(size, kinds[3]), pa.array(data, kinds[4])], out.names)

    shards = -(-total // shard)
    ranges = max(1, min(shards, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    each = -(-max(shards, 1) // ranges)
    numbered = kept.mapInArrow(number, out).withColumn("shard", F.floor(F.col("slot") / F.lit(shard)).cast("int"))
    dealt = numbered.repartitionById(-(-max(shards, 1) // each), F.floor(F.col("shard") / F.lit(each)).cast("int")).sortWithinPartitions("slot")
    return dealt.select("slot", "shard", ((F.col("slot") % shard) * F.octet_length("tokens")).alias("offset"), "doc_id", "part", "n_tokens", "tokens")


def write_shards(records: DataFrame, folder: str) -> DataFrame:
    """Write the records as binary files ``shard-<number>.bin``; one row per file: shard, path, first_slot, records.

    A file is written under a name of its own attempt and then renamed, so a repeated task does no harm.
    """

    def run(batches):
        from uuid import uuid4

        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        done, now, stream, temp, count, first = [], None, None, "", 0, 0

        def close():
            stream.close()
            store.move(temp, f"{base}/shard-{now:08d}.bin")
            done.append((now, f"{folder.rstrip('/')}/shard-{now:08d}.bin", first, count))

        for b in batches:
            for slot, shard, data in zip(*(b.column(k).to_pylist() for k in range(3))):
                if shard != now:
                    if now is not None:
                        close()
                    now, temp, count, first = shard, f"{base}/.shard-{shard:08d}.{uuid4().hex}", 0, slot
                    stream = store.open_output_stream(temp)
                if slot != first + count:
                    raise ValueError(f"slot {slot} follows {first + count - 1}")
                stream.write(data)
                count += 1
        if now is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t) for k, t in enumerate((pa.int32(), pa.string(), pa.int64(), pa.int64()))], ["shard", "path", "first_slot", "records"])

    return records.select("slot", "shard", "tokens").mapInArrow(run, "shard int, path string, first_slot long, records long")


def read_slots(folder: str, start: int, count: int, length: int = SEQUENCE, shard: int = SHARD, kind=np.uint16) -> np.ndarray:
    """Records ``start`` to ``start + count - 1`` as rows of ids, read shard after shard."""
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(folder)
    stride, out = length * np.dtype(kind).itemsize, []
    while count > 0:
        n = min(count, shard - start % shard)
        with store.open_input_file(f"{base}/shard-{start // shard:08d}.bin") as f:
            f.seek(start % shard * stride)
            data = f.read(n * stride)
        out.append(np.frombuffer(data, kind).reshape(-1, length))
        if len(data) < n * stride:
            break
        start, count = start + n, count - n
    return np.concatenate(out) if out else np.zeros((0, length), kind)


def op3_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training_order(read(spark, sf_dir, "documents").select("doc_id", "text"))
