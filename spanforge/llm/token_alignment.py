"""Alignment of two tokenizers' token ids over the same bytes.

Each text is tokenised in full by A (byte-level BPE, over a space and the text) and by B
(SentencePiece, which adds that space).  Both treat the parts between single blanks apart, so
what is known of a part is not worked out again.  The joined token bytes of both are
verified against the text.  Byte offsets where tokens of both end are *shared ends*; those whose
next tokens both start with a space are anchors and cut the text into windows of token
ids.  A window's alignment depends on its ids only, so it is kept in a table by the two
id tuples and looked up the next time: most windows are words seen before.  Windows of
more than ``MEMO_TOKENS`` ids are aligned each time.

A group is what lies between two shared ends; a link is a pair of token occurrences
whose byte ranges overlap.  Corpus-wide link counts: documents are handled in blocks of
about ``BLOCK`` bytes of text.  A block is reduced to its different id pairs with their
counts; these are summed over the corpus, and each block gets the sums of its own pairs
back.  No pair is ever joined document by document, so a pair that all documents hold
has one row a block.

Bounds: the tokenizer files (broadcast, their sizes are fixed), ``MEMO`` windows a worker (checked between blocks),
one block a task (a long text is a block of its own).

Defined results: null and empty texts, and texts whose token bytes differ from the text
(normalised by B), have no tokens: zeros and an empty ``groups``.  Repeated rows are counted
each; null ids stay; no documents give no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import os
import re
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import read, written

#: bytes of text handled together
BLOCK = 8 << 20
#: bytes of text tokenised at once
SLICE = 1 << 20
#: windows kept by a worker, with the parts they come from
MEMO = 250_000
MEMO_TOKENS = 32
#: characters of a part whose ids are kept
PIECE = 64
BETWEEN = re.compile(r"(?<=\S) (?=\S)")
ASCII_SPACES = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f"
COUNTS = ("n_a", "n_b", "n_groups", "n_links")
_LOADED: dict = {}


def byte_of_symbol() -> dict[str, int]:
    """The byte each symbol of a byte-level vocabulary stands for: visible Latin-1 characters for themselves, others counted from 256."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Pair:
    """Both tokenizers, the bytes of each id, and the table of aligned windows."""

    def __init__(self, a: bytes, b: bytes):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Tokenizer.from_buffer(a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b)
        symbol = byte_of_symbol()
        vocab = self.a.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (max(vocab.values()) + 1)
        for piece, k in vocab.items():
            self.bytes_a[k] = bytes(symbol[c] for c in piece) if all(c in symbol for c in piece) else piece.encode()
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]
        sizes = [[len(x) for x in t] for t in (self.bytes_a, self.bytes_b)]
        self.size_a, self.size_b = (np.array(x, np.int64) for x in sizes)
        self.space_a, self.space_b = (np.array([x.startswith(b" ") for x in t]) for t in (self.bytes_a, self.bytes_b))
        self.windows = Windows(*sizes)
        self.apart = not any("▁" in p.lstrip("▁") for p in pieces)
        #: tokens of A, of B, and window numbers of a part
        self.known: dict[str, tuple[int, int, list[int]] | None] = {}

    def read(self, texts: list[str]) -> list[tuple[int, int, list[int]] | None]:
        """Tokens of A, of B, and window numbers of each text; None where the token bytes differ from the text."""
        split = [self.pieces(t) for t in texts]
        known = self.known
        used = set().union(*split)
        new = [p for p in used if p not in known]
        self.together([p for p in new if not (p[0].isspace() or p[-1].isspace())])
        self.alone([p for p in new if p not in known])
        out: list[tuple[int, int, list[int]] | None] = []
        bad = {p for p in used if known[p] is None}
        for parts in split:
            if bad and not bad.isdisjoint(parts):
                out.append(None)
                continue
            n_a, n_b, numbers = zip(*map(known.__getitem__, parts), strict=True)
            out.append((sum(n_a), sum(n_b), list(chain.from_iterable(numbers))))
        for p in new:
            if len(p) > PIECE:
                del known[p]
        return out

    def clear(self) -> None:
        self.known.clear()
        self.windows.clear()

    def together(self, parts: list[str]) -> None:
        """Learn parts that are encoded as one text and cut at their ends; none if the bytes differ from that text or do not end there."""
        if not self.apart or len(parts) < 2:
            return
        text = " ".join(parts)
        a, b = self.a.encode_batch_fast([" " + text], add_special_tokens=False)[0].ids, self.b.encode(text)
        if not self.verified(a, b, text):
            return
        x, y, ends = np.array(a, np.int32), np.array(b, np.int32), np.cumsum([1 + len(p.encode()) for p in parts])
        reach = [np.cumsum(size[ids]) for size, ids in ((self.size_a, x), (self.size_b, y))]
        at_a, at_b = (np.searchsorted(r, ends) for r in reach)
        if (reach[0][at_a] != ends).any() or (reach[1][at_b] != ends).any():
            return
        cuts = self.split(x, y)
        numbers = self.numbers(x, y, *cuts)
        last = np.searchsorted(cuts[0], at_a + 1) + 1
        for p, n_a, n_b, i, j in zip(parts, np.diff(at_a, prepend=-1).tolist(), np.diff(at_b, prepend=-1).tolist(), [0, *last.tolist()], last.tolist(), strict=False):
            self.known[p] = n_a, n_b, numbers[i:j]

    def alone(self, parts: list[str]) -> None:
        """Learn parts that are encoded one by one; None where the bytes differ."""
        for p, a, b in zip(parts, self.a.encode_batch_fast([" " + p for p in parts], add_special_tokens=False), self.b.encode(parts, num_threads=1), strict=True):
            if self.verified(a.ids, b, p):
                x, y = np.array(a.ids, np.int32), np.array(b, np.int32)
                self.known[p] = len(x), len(y), self.numbers(x, y, *self.split(x, y))
            else:
                self.known[p] = None

    def verified(self, a: list[int], b: list[int], text: str) -> bool:
        want = (" " + text).encode()
        return b"".join(map(self.bytes_a.__getitem__, a)) == want and b"".join(map(self.bytes_b.__getitem__, b)) == want

    def pieces(self, text: str) -> list[str]:
        """Parts between single blanks, which both tokenizers treat apart.

        A starts a new word at a blank between two other characters.  B merges pieces of its
        vocabulary only, and none of them goes on over a blank (else the text stays whole).
        """
        if not self.apart:
            return [text]
        # all blanks cut unless one is at an end or beside white space
        if text[:1] == " " or text[-1:] == " " or any(f" {c}" in text or f"{c} " in text for c in (ASCII_SPACES if text.isascii() else filter(str.isspace, set(text)))):
            return BETWEEN.split(text)
        return text.split(" ")

    def split(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token positions (in A, in B) after which a window ends."""
        end_a, end_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        at = np.searchsorted(end_b, end_a)
        shared = np.flatnonzero(end_b[at] == end_a)
        at = at[shared]
        last = shared == len(a) - 1
        anchor = last | (self.space_a[a[np.minimum(shared + 1, len(a) - 1)]] & self.space_b[b[np.minimum(at + 1, len(b) - 1)]])
        return shared[anchor] + 1, at[anchor] + 1

    def numbers(self, x: np.ndarray, y: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray) -> list[int]:
        """Numbers of the windows that end at these token positions, aligning those that are new."""
        memo, out, a, b = self.windows, [], x.tolist(), y.tolist()
        ha, hb = x.tobytes(), y.tobytes()
        i = k = 0
        for j, m in zip(ends_a.tolist(), ends_b.tolist(), strict=True):
            key = (ha[4 * i : 4 * j], hb[4 * k : 4 * m])
            number = memo.get(key)
            if number is None:
                number = memo.add(a[i:j], b[k:m], key)
            out.append(number)
            i, k = j, m
        return out


class Windows(dict):
    """Number of each aligned window by its two id tuples (as bytes), with groups and links by number."""

    def __init__(self, size_a: list[int], size_b: list[int]):
        super().__init__()
        self.size_a, self.size_b = size_a, size_b
        self.name_a, self.name_b = ([str(k) for k in range(len(x))] for x in (size_a, size_b))
        self.clear()

    def clear(self) -> None:
        super().clear()
        self.texts: list[str] = []
        #: links are id pairs, as A id << 32 | B id
        self.groups, self.ends, self.flat = array("q"), array("q", [0]), array("q")

    def align(self, a: list[int], b: list[int]) -> tuple[list[str], list[int]]:
        """Groups as text, and links, of one window."""
        size_a, size_b, name_a, name_b = self.size_a, self.size_b, self.name_a, self.name_b
        x, y = a[0], b[0]
        i = j = 0
        end_a, end_b, of_a, of_b = size_a[x], size_b[y], name_a[x], name_b[y]
        groups, links = [], [x << 32 | y]
        while True:
            if end_a == end_b:
                groups.append(f"{of_a}|{of_b}")
                i, j = i + 1, j + 1
                if i == len(a):
                    return groups, links
                x, y = a[i], b[j]
                end_a, end_b, of_a, of_b = end_a + size_a[x], end_b + size_b[y], name_a[x], name_b[y]
            elif end_a < end_b:
                i += 1
                x = a[i]
                end_a, of_a = end_a + size_a[x], f"{of_a},{name_a[x]}"
            else:
                j += 1
                y = b[j]
                end_b, of_b = end_b + size_b[y], f"{of_b},{name_b[y]}"
            links.append(x << 32 | y)

    def add(self, a: list[int], b: list[int], key: tuple[bytes, bytes]) -> int:
        groups, links = self.align(a, b)
        number = len(self.texts)
        self.texts.append(";".join(groups))
        self.groups.append(len(groups))
        self.flat.extend(links)
        self.ends.append(len(self.flat))
        if len(a) <= MEMO_TOKENS and len(b) <= MEMO_TOKENS:
            self[key] = number
        return number

    def full(self) -> bool:
        return len(self.texts) > MEMO or len(self.flat) > 16 * MEMO

    def counted(self, texts: list[list[int]]) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
        """For each text, as window numbers: groups, links, its different pairs and how often each is linked."""
        groups, ends, flat = (np.frombuffer(x, x.typecode) for x in (self.groups, self.ends, self.flat))
        out = []
        for numbers in texts:
            w = np.array(numbers, np.int64)
            start, n = ends[w], ends[w + 1] - ends[w]
            total = int(n.sum())
            own, times = np.unique(flat[np.repeat(start - (np.cumsum(n) - n), n) + np.arange(total)], return_counts=True)
            out.append((int(groups[w].sum()), total, own, times))
        return out


def _pair(files) -> Pair:
    name = tuple((len(x), hash(x)) for x in files.value)
    if name not in _LOADED:  # kept by the Python worker for its next tasks
        _LOADED.clear()
        _LOADED[name] = Pair(*files.value)
    return _LOADED[name]


def tokenizer_files(a: str | None = None, b: str | None = None) -> tuple[bytes, bytes]:
    """Contents of the two tokenizer files; by default the installed public ones."""
    if a is None or b is None:
        import public_tokenizers

        a, b = a or public_tokenizers.path("byte_bpe_50k.json"), b or public_tokenizers.path("piece_bpe_32k.model")
    out = []
    for path in (a, b):
        with open(path, "rb") as f:
            out.append(f.read())
    return out[0], out[1]


def _slices(texts: list[str | None]):
    """Positions of texts of about SLICE bytes, together."""
    part, size = [], 0
    for k, t in enumerate(texts):
        if t:
            part.append(k)
            size += len(t)
            if size >= SLICE:
                yield part
                part, size = [], 0
    if part:
        yield part


def in_blocks(src: DataFrame, files, groups: bool = False, block: int = BLOCK) -> DataFrame:
    """One row per document of ``id, text``: counts, groups, its different id pairs (by their number in the block) and link counts.

    The first document of a block carries the block's pairs and their counts.
    """
    ddl = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups string, groups_sha256 string, block bigint, own array<int>, times array<int>, a array<int>, b array<int>, n array<bigint>"
    out = T.StructType([src.schema["id"], *T.StructType.fromDDL(ddl).fields])
    schema = to_arrow_schema(out)

    def documents(pair: Pair, texts: list[str]) -> list[tuple | None]:
        """For each text: counts, groups, their digest, pairs and times; None where the bytes differ."""
        got = pair.read(texts)
        good = [k for k, x in enumerate(got) if x]
        out: list[tuple | None] = [None] * len(texts)
        for k, (n_groups, n_links, pairs, times) in zip(good, pair.windows.counted([got[k][2] for k in good]), strict=True):
            n_a, n_b, numbers = got[k]
            text = ";".join(map(pair.windows.texts.__getitem__, numbers))
            out[k] = (n_a, n_b, n_groups, n_links), text if groups else None, hashlib.sha256(text.encode()).hexdigest(), pairs, times
        return out

    def run(batches):
        pair = _pair(files)
        number = TaskContext.get().partitionId() << 32
        held, ids, size = [], [], 0

        def flush():
            nonlocal held, ids, size, number
            many = np.concatenate([np.zeros(0, np.int64), *[d[3] for d in held if d]])
            used, first = np.unique(many, return_inverse=True)
            total = np.bincount(first, np.concatenate([np.zeros(0), *[d[4] for d in held if d]]), len(used)).astype(np.int64)
            empty = ((0, 0, 0, 0), "" if groups else None, "", np.zeros(0, np.int64), np.zeros(0, np.int64))
            cuts = np.cumsum([0, *[len(d[3]) if d else 0 for d in held]])
            docs = [d or empty for d in held]
            nothing = [None] * (len(docs) - 1)
            columns = [
                *[[d[0][k] for d in docs] for k in range(4)], [d[1] for d in docs], [d[2] for d in docs], [number] * len(docs),
                [first[i:j] for i, j in zip(cuts, cuts[1:], strict=False)], [d[4] for d in docs],
                [(used >> 32).astype(np.int32), *nothing], [(used & 0xFFFFFFFF).astype(np.int32), *nothing], [total, *nothing],
            ]
            got = pa.RecordBatch.from_arrays([pa.concat_arrays(ids), *[pa.array(c, f.type) for c, f in zip(columns, list(schema)[1:], strict=True)]], schema=schema)
            held, ids, size, number = [], [], 0, number + 1
            if pair.windows.full():
                pair.clear()
            return got

        for b in batches:
            texts, done = b.column(1).to_pylist(), 0
            for part in [*_slices(texts), []]:
                upto = part[-1] + 1 if part else len(texts)
                made = dict.fromkeys(range(done, upto)) | dict(zip(part, documents(pair, [texts[k] for k in part]), strict=True))
                size += sum(len(texts[k]) for k in part)
                held += made.values()
                ids.append(b.column(0)[done:upto])
                done = upto
                if size >= block:
                    yield flush()
        if held:
            yield flush()

    return src.mapInArrow(run, out)


def corpus_counts(blocks: DataFrame) -> DataFrame:
    """``block_, number, count, best`` of the pairs of each block: links of the pair corpus-wide, and whether its B id has no pair with more."""
    pairs = blocks.where("a is not null").select("block", F.posexplode(F.arrays_zip("a", "b", "n")).alias("number", "p")).select("block", "number", "p.*")
    sums = pairs.groupBy("a", "b").agg(F.sum("n").alias("count"))
    top = sums.groupBy(F.col("b").alias("b_")).agg(F.max("count").alias("top"))
    sums = sums.join(top, F.col("b") == F.col("b_")).select(F.col("a").alias("a_"), F.col("b").alias("b_"), "count", (F.col("count") == F.col("top")).alias("best"))
    return pairs.join(sums, F.expr("a = a_ and b = b_")).select(F.col("block").alias("block_"), "number", "count", "best")


def scored(blocks: DataFrame, counts: DataFrame) -> DataFrame:
    """Adds ``n_best`` and ``count_sum`` to the documents of each block."""
    plain = ["id", *COUNTS, "groups", "groups_sha256"]
    out = T.StructType([*blocks.select(*plain).schema.fields, *T.StructType.fromDDL("n_best bigint, count_sum bigint").fields])
    kinds = to_arrow_schema(out)

    def block(docs: pa.Table, sums: pa.Table) -> pa.Table:
        count, best = np.zeros(sums.num_rows, np.int64), np.zeros(sums.num_rows, np.int64)
        at = sums["number"].to_numpy()
        count[at], best[at] = sums["count"].to_numpy(), sums["best"].to_numpy().astype(np.int64)
        own, times = (docs[c].combine_chunks() for c in ("own", "times"))
        flat, times, edges = own.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64), own.offsets.to_numpy() - own.offsets[0].as_py()
        sums = [np.r_[0, np.cumsum(times * x[flat])] for x in (best, count)]
        return pa.Table.from_arrays([*[docs[c] for c in plain], *[pa.array(x[edges[1:]] - x[edges[:-1]]) for x in sums]], schema=kinds)

    docs = blocks.select(*plain, "block", "own", "times").groupBy("block")
    return docs.cogroup(counts.groupBy("block_")).applyInArrow(block, out)


def aligned(docs: DataFrame, ident: str = "doc_id", text: str = "text", tokenizers: tuple[bytes, bytes] | None = None, groups: bool = False, block: int = BLOCK) -> DataFrame:
    """One row per document: ``id``, token, group and link counts, corpus-wide link figures and, if asked for, the groups.

    ``tokenizers`` holds the contents of the two files (A as JSON, B as a SentencePiece model).
    """
    src = docs.select(F.col(f"`{ident}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    files = docs.sparkSession.sparkContext.broadcast(tokenizers or tokenizer_files())
    blocks = written(in_blocks(src, files, groups, block))
    return scored(blocks, corpus_counts(blocks))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = aligned(read(spark, sf_dir, "documents"))
    return got.select(F.col("id").alias("doc_id"), *COUNTS, "n_best", "count_sum", "groups_sha256")
