"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

A document gets the key ``-ln(u) / weight``: ``u`` is uniform and comes from a
hash of id and text, ``weight`` is its quality.  Within a source the smallest
keys come first.  A source's target is met by complete epochs (every document
once each) and then by the documents in key order whose sizes fill the rest;
the document at the border is taken if that comes nearer to the target.

No source is sorted as a whole.  Keys fall into ``BUCKETS`` ranges of equal
expected mass, sizes are summed per (source, range) with map-side combine, and
only the one range that holds a source's border is ordered.  The border is one
key per source, so the decision about a row needs no shuffle of rows.

Defined results: null or empty texts have size 0 and are taken by epochs only;
sources are ordered by code point, null last; identical rows share a key, and where
the border runs through them as many are taken as fit; no rows or only empty texts give targets of 0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from .common import bounded, read, saved, word_count

BUCKETS = 4096
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0


def quality(text: Column) -> Column:
    """Quality weight in (1, 2]: falls with the share of symbol characters."""
    symbols = F.coalesce(F.regexp_count(text, F.lit(r"[#*$%&|<>]")), F.lit(0)).cast("double")
    return F.lit(1.0) + F.lit(1.0) / (F.lit(1.0) + F.lit(20.0) * symbols / F.greatest(F.coalesce(F.length(text), F.lit(0)), F.lit(1)).cast("double"))


def keyed(docs: DataFrame, weight: Column | None = None) -> DataFrame:
    """``row`` (all columns of docs) with size, key and key range."""
    text, ident = F.col("text"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    digest = F.md5(F.concat(ident, F.lit(":"), F.coalesce(text, F.lit(""))))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 52))
    out = docs.select(F.struct("*").alias("row"), F.col("source").alias("source"), word_count(text).alias("size"), (-F.log(u) / (quality(text) if weight is None else weight)).alias("key"))
    return out.withColumn("bucket", F.least(F.floor((F.lit(1.0) - F.exp(-F.col("key"))) * BUCKETS), F.lit(BUCKETS - 1)).cast("int"))


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Target per source: ``share`` of all sizes by weight, none above ``most`` times its size.

    The capped sources are those with the smallest cap per weight, so one pass in
    that order finds the common level of the others.  One row per source.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.col("pos") - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sizes.withColumn("pos", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))).withColumn("w", w).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    order = W.orderBy(F.col("cap") / F.col("w"), "pos")
    s = s.withColumn("before", F.sum("cap").over(order) - F.col("cap")).withColumn("left", F.sum("w").over(W.partitionBy()) - F.sum("w").over(order) + F.col("w"))
    s = s.withColumn("level", (F.lit(float(share)) * F.sum("source_size").over(W.partitionBy()) - F.col("before")) / F.col("left"))
    level = F.min_by(F.when(F.col("cap") > F.col("level") * F.col("w"), F.col("level")), F.when(F.col("cap") > F.col("level") * F.col("w"), F.col("before"))).over(W.partitionBy())
    s = s.withColumn("common", level)
    return s.select("source", "source_size", F.least(F.col("cap"), F.coalesce(F.col("common") * F.col("w"), F.col("cap"))).alias("target"))


def plan_mix(rows: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """One row per source: size, target, epochs and the border of the fractional part.

    ``rows`` has source, size, key, bucket and ``ident``, and is read twice.
    """
    sums = saved(rows.groupBy("source", "bucket").agg(F.sum("size").alias("size")))
    sizes = sums.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = targets(sizes, weights, share, most)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    plan = saved(plan.withColumn("epochs", epochs).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")))
    p = bounded(plan)
    run = W.partitionBy("source").orderBy("bucket")
    border = sums.withColumn("before", F.sum("size").over(run) - F.col("size")).alias("s").join(p.alias("p"), F.col("s.source").eqNullSafe(F.col("p.source")))
    border = border.where((F.col("before") < F.col("rest")) & (F.col("before") + F.col("size") >= F.col("rest")))
    border = saved(border.select(F.col("s.source").alias("b_source"), F.col("bucket").alias("b_bucket"), "before", "rest"))
    inside = rows.join(bounded(border), rows.source.eqNullSafe(F.col("b_source")) & (rows.bucket == F.col("b_bucket")))
    order = W.partitionBy("source").orderBy("key", "ident", "size").rowsBetween(W.unboundedPreceding, W.currentRow)
    inside = inside.withColumn("start", F.col("before") + F.sum("size").over(order) - F.col("size"))
    fits = (F.col("start") < F.col("rest")) & (F.lit(2) * (F.col("rest") - F.col("start")) >= F.col("size"))
    alike = inside.groupBy("b_source", "b_bucket", "key", "ident", "size").agg(F.count_if(fits).alias("k"), F.count("*").alias("t")).where("k > 0")
    last = alike.groupBy("b_source", "b_bucket").agg(F.max(F.struct("key", "ident", "size", "k", "t")).alias("last"))
    out = plan.alias("p").join(border.select(F.col("b_source").alias("c_source"), F.col("b_bucket").alias("border")), F.col("source").eqNullSafe(F.col("c_source")), "left")
    out = out.join(last, F.col("source").eqNullSafe(F.col("b_source")), "left")
    return saved(out.select(F.col("source").alias("m_source"), "source_size", "target", "epochs", "border", "last"))


def taken_copies(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows with the plan of their source and ``copies``, how often the mix takes them."""
    out = rows.join(bounded(plan), F.col("source").eqNullSafe(F.col("m_source")))
    own, last = F.struct("key", "ident", "size"), F.struct("last.key", "last.ident", "last.size")
    here = F.coalesce(F.col("bucket") == F.col("border"), F.lit(False))
    chosen = F.coalesce((F.col("bucket") < F.col("border")) | (here & (own <= last)), F.lit(False))
    done = out.withColumn("copies", F.col("epochs") + chosen.cast("int"))
    if plan.where("last.k < last.t").isEmpty():
        return done
    # the border runs through identical rows: as many of them as fit
    split = F.coalesce(here & (own == last) & (F.col("last.k") < F.col("last.t")), F.lit(False))
    nth = F.row_number().over(W.partitionBy("source", "key").orderBy(F.lit(0)))
    some = done.where(split).withColumn("copies", F.col("epochs") + (nth <= F.col("last.k")).cast("int"))
    return done.where(~split).unionByName(some)


def _light(rows: DataFrame) -> DataFrame:
    return rows.select("source", "size", "key", "bucket", F.coalesce(F.col("row.doc_id").cast("string"), F.lit("")).alias("ident"))


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """The mixture itself: every document as often as the mix takes it, with the columns of docs."""
    rows = keyed(docs)
    plan = plan_mix(saved(_light(rows)), weights, share, most)
    out = taken_copies(rows.withColumn("ident", F.coalesce(F.col("row.doc_id").cast("string"), F.lit(""))), plan)
    return out.select("row", F.explode(F.expr("array_repeat(1, copies)")).alias("_copy")).select("row.*")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    rows = saved(keyed(docs).select("source", "size", "key", "bucket", F.col("row.doc_id").alias("doc_id"), F.coalesce(F.col("row.doc_id").cast("string"), F.lit("")).alias("ident")))
    return taken_copies(rows, plan_mix(rows)).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


SQL = """
with d as (select doc_id, source, text, cast(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) as bigint) as size,
  1e0 + 1e0 / (1e0 + 2e1 * coalesce(len(regexp_extract_all(text, '[#*$%&|<>]')), 0)::double / greatest(coalesce(length(text), 0), 1)::double) as q,
  (('0x' || substr(md5(coalesce(doc_id::varchar, '') || ':' || coalesce(text, '')), 1, 13))::bigint + 5e-1) / 4503599627370496e0 as u from documents),
k as (select doc_id, source, size, -ln(u) / q as key, coalesce(doc_id::varchar, '') as ident from d),
s as (select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) as pos from k group by source),
t as (select *, case (pos - 1) % 3 when 0 then 5e0 when 1 then 2e0 else 1e0 end as w, 2e0 * source_size as cap from s),
o as (select *, sum(cap) over (order by cap / w, pos) - cap as before, sum(w) over () - sum(w) over (order by cap / w, pos) + w as rest_w from t),
l as (select *, (1.5e0 * sum(source_size) over () - before) / rest_w as level from o),
g as (select *, (select arg_min(level, before) from l where cap > level * w) as common from l),
p as (select source, source_size, least(cap, coalesce(common * w, cap)) as target from g),
e as (select *, case when source_size > 0 then floor(target / source_size)::int else 0 end as epochs from p),
r as (select k.*, source_size, target, epochs, target - epochs * source_size as rest,
  sum(size) over (partition by k.source order by key, ident, size rows unbounded preceding) - size as start
  from k join e on k.source is not distinct from e.source)
select doc_id, size, source_size, target, (copies * size)::bigint as taken, copies from (
  select *, epochs + case when start < rest and 2 * (rest - start) >= size then 1 else 0 end as copies from r)"""
