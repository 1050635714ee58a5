"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Base rules come first: too few words, or too many words inside repeated 3-word
windows.  Then each metric (share of symbols, of repeated words, of repeated
lines, of capitals) gets a cutoff per stratum, chosen on labelled documents: among
the ``STEPS`` cutoffs of a fixed grid, those are admissible whose count of good
documents rejected is so low that the exact binomial test rules out a false
rejection rate above ``RISK / metrics`` at level ``LEVEL / (metrics * strata)``
(union bound over metrics, Bonferroni over metrics and strata; along the grid the
tests are nested, so they run in fixed sequence at the same level).  Of the
admissible cutoffs the one that rejects most bad documents is taken, the mildest
on ties.  With too few labels nothing is admissible and the metric rejects nothing.

All work within a text is done in array functions of its row: no exploded words.

Defined results: null or empty texts have zero counts and fail the base rule; a
null stratum is one stratum; a document with contradictory labels counts as bad;
labels of unknown documents are ignored; repeated rows are judged alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from .common import WORD, bounded, read, saved

MIN_WORDS = 50
RISK = 0.02
LEVEL = 0.05
STEPS = 50
METRICS = {"symbols": ("n_symbols", "word_chars"), "repeats": ("n_repeat_words", "n_words"), "lines": ("n_dup_lines", "n_lines"), "capitals": ("n_capitals", "word_chars")}


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body``; a plain reference would be evaluated per array element."""
    return F.transform(F.array(value), body)[0]


def repeat_words(words: Column) -> Column:
    """Number of words in 3-word windows that occur at least twice.

    Windows are sorted by hash, equal neighbours are kept, and the lengths of the
    union of the kept windows are added up in order of position.
    """

    def windows(w):
        return F.transform(F.slice(w, F.lit(1), F.greatest(F.size(w) - 2, F.lit(0))), lambda x, i: F.struct(F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")))

    def twice(s):
        return F.sort_array(F.transform(F.filter(s, lambda e, j: (F.get(s, j - 1)["h"] == e["h"]) | (F.get(s, j + 1)["h"] == e["h"])), lambda e: e["i"]))

    def add(acc, i):
        return F.struct((acc["n"] + F.least(F.lit(3), i + 3 - acc["end"])).alias("n"), (i + 3).alias("end"))

    sized = let(words, lambda w: let(F.sort_array(windows(w)), twice))
    return F.aggregate(sized, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), add, lambda acc: acc["n"].cast("long"))


def measures(docs: DataFrame, ident: str, text: str, stratum: str) -> DataFrame:
    t = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.regexp_like(x, F.lit(WORD)))
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    words = F.regexp_extract_all(t, F.lit(f"({WORD})"), F.lit(1))
    both = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), repeat_words(w).alias("r")))
    split = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("d")))
    out = docs.select(F.col(f"`{ident}`").alias("id"), F.coalesce(F.col(f"`{stratum}`").cast("string"), F.lit("")).alias("stratum"), both.alias("w"), split.alias("l"),
        F.length(F.regexp_replace(t, r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"), count(F.regexp_count(t, F.lit(r"[#*$%&|<>]"))).alias("n_symbols"), count(F.regexp_count(t, F.lit("[A-Z]"))).alias("n_capitals"))
    return out.select("id", "stratum", F.col("w.n").alias("n_words"), "word_chars", "n_symbols", F.col("l.d").alias("n_dup_lines"), F.col("w.r").alias("n_repeat_words"), F.col("l.n").alias("n_lines"), "n_capitals")


def bucket(num: str, den: str) -> Column:
    return F.when(F.col(den) > 0, F.least(F.floor(F.lit(float(STEPS)) * F.col(num) / F.col(den)), F.lit(STEPS))).otherwise(0).cast("int")


def binomial_cdf(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X ~ Bin(n, p) and k < n p, summed from its largest term down."""
    odds = p / (1 - p)
    to_k = F.when(k > 0, F.sequence(F.lit(1), k)).otherwise(F.array().cast("array<int>"))
    top = F.aggregate(to_k, n * F.log(F.lit(1 - p)), lambda acc, j: acc + F.log((n - j + 1) * F.lit(odds) / j))
    down = F.aggregate(to_k, F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s")), lambda acc, j: let(acc["t"] * (k - j + 1) / ((n - k + j) * F.lit(odds)), lambda t: F.struct(t.alias("t"), (acc["s"] + t).alias("s"))), lambda acc: acc["s"])
    return F.exp(top) * down


def cutoffs(rows: DataFrame, labels: DataFrame, risk: float = RISK, level: float = LEVEL) -> DataFrame:
    """Per stratum and metric the chosen grid cutoff; rows without an admissible one are absent.

    ``rows`` are measured documents that passed the base rules, ``labels`` has
    ``id`` and ``good`` (boolean).
    """
    truth = labels.where("id is not null and good is not null").groupBy("id").agg(F.min("good").alias("good"))
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), bucket(a, b).alias("b")) for m, (a, b) in METRICS.items()])
    seen = rows.join(truth, "id").select("stratum", "good", F.explode(pairs).alias("m")).groupBy("stratum", F.col("m.metric").alias("metric"), F.col("m.b").alias("b"))
    seen = saved(seen.agg(F.count_if("good").cast("int").alias("good"), F.count_if(~F.col("good")).cast("int").alias("bad")))
    per = W.partitionBy("stratum", "metric")
    down = per.orderBy(F.desc("b"))
    grid = seen.select("stratum", "metric", "b", F.sum("good").over(down).cast("int").alias("k"), F.sum("bad").over(down).cast("int").alias("bad"), F.sum("good").over(per).cast("int").alias("n"))
    strata = seen.select("stratum").distinct().count()
    p = risk / len(METRICS)
    sure = F.when(F.col("k") < F.col("n") * F.lit(p), binomial_cdf(F.col("k"), F.col("n"), p) <= F.lit(level / (len(METRICS) * max(strata, 1)))).otherwise(False)
    chosen = grid.where((F.col("b") > 0) & sure & (F.col("bad") > 0)).groupBy("stratum", "metric").agg(F.max(F.struct("bad", "b"))["b"].alias("cut"))
    return chosen.groupBy(F.col("stratum").alias("c_stratum")).agg(*[F.min(F.when(F.col("metric") == m, F.col("cut"))).alias(f"cut_{m}") for m in METRICS])


def judge(docs: DataFrame, labels: DataFrame, ident: str = "doc_id", text: str = "text", stratum: str = "lang", risk: float = RISK, level: float = LEVEL) -> DataFrame:
    """``id``, the measures, ``base_failed``, ``failed`` (metrics that reject) and ``kept``."""
    rows = measures(docs, ident, text, stratum)
    base = (F.col("n_words") < MIN_WORDS) | (F.lit(100) * F.col("n_repeat_words") > F.lit(50) * F.col("n_words"))
    rows = saved(rows.withColumn("base_failed", base))
    cuts = saved(cutoffs(rows.where("not base_failed"), labels, risk, level))
    out = rows.join(bounded(cuts), F.col("stratum") == F.col("c_stratum"), "left")
    failed = F.array_compact(F.array(*[F.when(bucket(a, b) >= F.col(f"cut_{m}"), F.lit(m)) for m, (a, b) in METRICS.items()]))
    out = out.withColumn("failed", failed)
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0)).drop("c_stratum", *[f"cut_{m}" for m in METRICS])


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    labels = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), (F.col("quality") == 1).alias("good"))
    out = judge(docs, labels)
    return out.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_P = RISK / len(METRICS)
_W = r"'[^\x20\x09-\x0D]+'"
_CDF = f"list_sum(list_transform(range(0, k::bigint + 1), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({_P}) + (n - j) * ln(1 - {_P}))))"
SQL = f"""
with t as (select doc_id, row_number() over () as rid, coalesce(lang, '') as stratum, coalesce(text, '') as x, regexp_extract_all(coalesce(text, ''), {_W}) as w from documents),
g as (select rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as g from (select rid, w, unnest(range(1, len(w) - 1)) as i from t where len(w) > 2)),
r as (select rid, count(distinct p) as n from (select rid, unnest([i, i + 1, i + 2]) as p from (select *, count(*) over (partition by rid, g) as c from g) where c > 1) group by rid),
l as (select rid, count(*) as n, count(distinct s) as d from (select rid, unnest(string_split(x, chr(10))) as s from t) where regexp_matches(s, {_W}) group by rid),
m as (select t.rid, doc_id, stratum, len(w)::bigint as n_words, length(regexp_replace(x, '[\\x20\\x09-\\x0D]+', '', 'g'))::bigint as word_chars, len(regexp_extract_all(x, '[#*$%&|<>]'))::bigint as n_symbols,
  coalesce(l.n - l.d, 0)::bigint as n_dup_lines, coalesce(r.n, 0)::bigint as n_repeat_words, coalesce(l.n, 0)::bigint as n_lines, len(regexp_extract_all(x, '[A-Z]'))::bigint as n_capitals
  from t left join r using (rid) left join l using (rid)),
b as (select *, n_words < {MIN_WORDS} or 100 * n_repeat_words > 50 * n_words as base_failed from m),
q as (select doc_id, min(quality) = 1 as good from labels where quality is not null group by doc_id),
u as ({' union all '.join(f"select rid, stratum, doc_id, base_failed, '{k}' as metric, case when {d} > 0 then least(floor({STEPS}e0 * {n} / {d}), {STEPS}) else 0 end::int as b from b" for k, (n, d) in METRICS.items())}),
s as (select stratum, metric, b, count(*) filter (good) as good, count(*) filter (not good) as bad from u join q using (doc_id) where not base_failed group by all),
c as (select stratum, metric, b, sum(good) over o as k, sum(bad) over o as bad, sum(good) over (partition by stratum, metric) as n from s window o as (partition by stratum, metric order by b desc)),
v as (select stratum, metric, max(struct_pack(bad := bad, b := b)).b as cut from c
  where b > 0 and bad > 0 and k < n * {_P} and {_CDF} <= {LEVEL} / ({len(METRICS)} * (select count(distinct stratum) from s)) group by stratum, metric),
f as (select distinct rid from u join v using (stratum, metric) where u.b >= v.cut)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and f.rid is null as kept from b left join f using (rid)"""
