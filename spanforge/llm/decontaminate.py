"""Benchmark decontamination with one Aho-Corasick automaton.

Texts are normalised byte for byte (A-Z to lower case, other ASCII but digits and
letters to blanks), so word offsets stay offsets of the original.  The automaton
works on words: the benchmark's vocabulary gives each word a number, other words
are 0, and its patterns are all windows of ``WINDOW`` words of an item, or the
whole item if it is shorter.  Each text is scanned once.

The benchmark, a fixed set of tests, is read in chunks of at most
``MAX_WINDOWS`` windows; each chunk is one automaton, sent to the tasks, and one
scan of the documents.  Real benchmarks fit in one chunk.

Defined results: null or wordless documents have no words and are clean; items
with null or wordless text match nothing; a null item_id counts as the id "";
repeated rows of an item count as one item; without a benchmark all is clean.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import read, scan

WINDOW = 13
MAX_WINDOWS = 400_000
SHARE = 20

_KEEP = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_KEEP).split() if text else []


def chunks(items: DataFrame, window: int, most: int) -> Iterator[tuple[dict[bytes, int], dict[tuple[int, ...], set[str]]]]:
    """Vocabulary and windows (with their items) of the benchmark, chunk by chunk."""
    vocab: dict[bytes, int] = {}
    patterns: dict[tuple[int, ...], set[str]] = {}
    for r in items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("id"), F.col("text").cast("string").alias("text")).where("text is not null").toLocalIterator():
        ids = [vocab.setdefault(w, len(vocab) + 1) for w in words_of(r["text"].encode())]
        size = min(window, len(ids))
        for i in range(len(ids) - size + 1 if size else 0):
            patterns.setdefault(tuple(ids[i : i + size]), set()).add(r["id"])
        if len(patterns) >= most:
            yield vocab, patterns
            vocab, patterns = {}, {}
    yield vocab, patterns


def offsets(text: bytes, flags: bytearray) -> list[tuple[int, int]]:
    """Character offsets in the original of each run of hit words."""
    out, start, end = [], -1, -1
    for k, m in enumerate(re.finditer(rb"[^ ]+", text.translate(_KEEP))):
        if flags[k]:
            start, end = (m.start() if start < 0 else start), m.end()
        elif start >= 0:
            out.append((start, end))
            start = -1
    if start >= 0:
        out.append((start, end))
    chars = lambda b: len(text[:b].decode("utf-8", "replace"))
    return [(chars(a), chars(b)) for a, b in out]


def _scanner(shared):
    def make():
        import ahocorasick

        vocab, patterns = shared.value
        automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for p, ids in patterns.items():
            automaton.add_word(p, (len(p), ids))
        if patterns:
            automaton.make_automaton()
        number = vocab.get

        def one(text: bytes | None):
            words = words_of(text or b"")
            if not words or not patterns:
                return len(words), [], [], []
            flags, found = None, set()
            for end, (size, ids) in automaton.iter(tuple([number(w, 0) for w in words])):
                flags = flags or bytearray(len(words))
                flags[end - size + 1 : end + 1] = b"\1" * size
                found |= ids
            if flags is None:
                return len(words), [], [], []
            return len(words), [i for i, f in enumerate(flags) if f], sorted(found), offsets(text, flags)

        def work(texts):
            rows = [one(t) for t in texts]
            return [[r[i] for r in rows] for i in range(4)]

        return work

    return make


def contamination(docs: DataFrame, items: DataFrame, text: str = "text", window: int = WINDOW, carry: list[str] | None = None, most: int = MAX_WINDOWS) -> DataFrame:
    """``row`` (the columns in ``carry``, default all) with ``n_words, n_hit, items, spans, contaminated``.

    ``items`` are the sorted ids of the items that occur, ``spans`` the character
    offsets of the hit passages in the original text.
    """
    sc = docs.sparkSession.sparkContext
    ddl = "n_words long, hits array<int>, items array<string>, spans array<struct<start:int,end:int>>"
    parts = chunks(items, window, most)
    first, second = next(parts), next(parts, None)
    out = scan(docs, _scanner(sc.broadcast(first)), ddl, text, carry if second is None else None)
    for part in itertools.chain([] if second is None else [second], parts):  # beyond one automaton: another scan that carries the earlier hits
        out = scan(out.withColumn("_t", F.col(f"row.`{text}`")), _scanner(sc.broadcast(part)), ddl, "_t", ["row", "hits", "items", "spans"])
        old = [F.col(f"row.{c}") for c in ("hits", "items", "spans")]
        out = out.select(
            F.col("row.row").alias("row"), "n_words", F.array_distinct(F.concat("hits", old[0])).alias("hits"), F.array_sort(F.array_distinct(F.concat("items", old[1]))).alias("items"), F.array_sort(F.array_distinct(F.concat("spans", old[2]))).alias("spans")
        )
    if second is not None and carry is not None:
        out = out.withColumn("row", F.struct(*[F.col(f"row.`{c}`") for c in carry]))
    n_hit = F.size("hits").cast("long")
    return out.select("row", "n_words", n_hit.alias("n_hit"), "items", "spans", ((n_hit > 0) & (F.lit(SHARE) * n_hit >= F.col("n_words"))).alias("contaminated"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    items = read(spark, sf_dir, "benchmark").select("item_id", "text")
    out = contamination(docs, items, carry=["doc_id"])
    return out.select(F.col("row.doc_id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = f"""
with d as (select doc_id, row_number() over () as rid, coalesce({_WORDS}, []) as w from documents),
b as (select coalesce(item_id::varchar, '') as id, {_WORDS} as w, least(len({_WORDS}), {WINDOW}) as k from benchmark where text is not null),
g as (select distinct id, k, array_to_string(w[i:i + k - 1], ' ') as gram from (select *, unnest(range(1, len(w) - k + 2)) as i from b where k > 0)),
ks as (select distinct k from g),
x as (select rid, i, k, array_to_string(w[i:i + k - 1], ' ') as gram from (select rid, w, k, unnest(range(1, len(w) - k + 2)) as i from d, ks where len(w) >= k)),
m as (select x.rid, x.i, x.k, g.id from x join g on x.k = g.k and x.gram = g.gram),
h as (select rid, count(distinct p) as n_hit from (select rid, unnest(range(i, i + k)) as p from m) group by rid),
t as (select rid, count(distinct id) as n_items, string_agg(distinct id, ',' order by id) as ids from m group by rid)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(ids, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 and {SHARE} * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join h using (rid) left join t using (rid)"""
