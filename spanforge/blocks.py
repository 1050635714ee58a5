"""Building blocks for timelines that may be skewed by recording.

One recording can hold a third of all rows, so no window runs over its raw rows:

* ``islands``   first reduces rows to one per ``(recording, second)`` with
                map-side combine; what is left is bounded by the length of the
                recording (86,400 rows a day), and only that is ordered;
* ``with_halo`` neighbourhood windows: the timeline is cut into blocks of
                seconds and rows near an edge are copied to the next block, so
                a long recording spreads over many tasks;
* ``carry``     running aggregate; plain for inputs already reduced to seconds,
                two-level (per block, then over block summaries) for raw rows;
* ``span_join`` / ``point_join``  range joins keyed by ``(recording, block)``.
"""

from __future__ import annotations

import tempfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

#: default block length in seconds
BLOCK = 900


def block_of(t: Column | str, block: int) -> Column:
    return F.floor(_c(t) / F.lit(block)).cast("long")


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def shared_folder(spark: SparkSession) -> str:
    """The folder driver and executors share: ``spark.checkpoint.dir``; a temporary one stands in only in local mode."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write a small intermediate result once so later steps share it.

    Used for tables that several branches of a job read (matches, windows):
    without it each branch would scan the sources again.  Files go to the
    shared folder, so a lost executor loses nothing.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def positions(df: DataFrame, order: Sequence[Column | str], weight: Column | None = None, out: str = "__i") -> DataFrame:
    """Zero-based position of each row in one order of all rows, of any type.

    Rows are dealt to ranges of the order and written (``cut``), ordered within a
    range, and ranges are added up from one row each.  With ``weight`` the position
    is the sum of the weights of all earlier rows.
    """
    w = F.lit(1) if weight is None else weight
    x = cut(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()).withColumn("__w", w))
    sizes = x.groupBy("__part").agg(F.sum("__w").alias("__s"))
    before = sizes.select("__part", (F.sum("__s").over(W.orderBy("__part")) - F.col("__s")).alias("__before"))
    inside = W.partitionBy("__part").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    x = x.withColumn("__own", F.sum("__w").over(inside) - F.col("__w")).join(before, "__part")
    return x.withColumn(out, F.col("__own") + F.col("__before")).drop("__part", "__w", "__own", "__before")


def once(df: DataFrame, name: str, expr: Column) -> DataFrame:
    """Add a column whose costly expression is evaluated once per row.

    Later projections would otherwise each get a copy of it (decoding a JSON
    text once per extracted field); a generator step is never merged.
    """
    return df.select("*", F.explode(F.array(expr)).alias(name))


def carry(
    df: DataFrame,
    keys: Sequence[str],
    t: str,
    values: dict[str, tuple[str, Column]],
    order: Sequence[Column | str] | None = None,
    block: int | None = None,
    reverse: bool = False,
) -> DataFrame:
    """Running aggregates over all *earlier* rows of the same key.

    ``values`` maps an output column to ``(kind, expression)`` with kind one of
    ``max min sum last``; ``last`` skips nulls.  ``order`` starts with ``t``.
    With ``reverse`` the aggregate runs over all later rows instead.

    Without ``block`` the input has to be bounded per key (one row per second,
    see ``islands``).  With ``block`` rows are ordered per block of ``t`` only
    and one summary row per block is ordered per key.
    """
    keys = list(keys)
    order = list(order or [t])
    sort = [_c(c).desc() if reverse else _c(c).asc() for c in order]
    if block is None:
        w = W.partitionBy(*keys).orderBy(*sort).rowsBetween(W.unboundedPreceding, -1)
        got = {out: _running(kind, expr).over(w) for out, (kind, expr) in values.items()}
        zero = {out for out, (kind, _) in values.items() if kind == "sum"}
        return df.withColumns({out: F.coalesce(c, F.lit(0)) if out in zero else c for out, c in got.items()})
    blk = F.col("__blk").desc() if reverse else F.col("__blk").asc()
    base = df.withColumn("__blk", block_of(t, block))
    tmp = {f"__v{i}": (out, kind, expr) for i, (out, (kind, expr)) in enumerate(values.items())}
    base = base.withColumns({name: expr for name, (_, _, expr) in tmp.items()})

    pos = F.struct(*[_c(c) for c in order])
    summaries = []
    for name, (_, kind, _) in tmp.items():
        col = F.col(name)
        if kind == "last":
            at = F.when(col.isNotNull(), pos)
            summaries.append((F.min_by(col, at) if reverse else F.max_by(col, at)).alias(name))
        else:
            summaries.append({"max": F.max, "min": F.min, "sum": F.sum}[kind](col).alias(name))
    per_block = base.groupBy(*keys, "__blk").agg(*summaries)
    over_blocks = W.partitionBy(*keys).orderBy(blk).rowsBetween(W.unboundedPreceding, -1)
    carried = per_block.select(
        *keys,
        "__blk",
        *[_running(kind, F.col(name)).over(over_blocks).alias(f"__c{name}") for name, (_, kind, _) in tmp.items()],
    )
    inside = W.partitionBy(*keys, "__blk").orderBy(*sort).rowsBetween(W.unboundedPreceding, -1)
    out = base.join(carried, [*keys, "__blk"], "left")
    for name, (target, kind, _) in tmp.items():
        local, before = _running(kind, F.col(name)).over(inside), F.col(f"__c{name}")
        if kind == "max":
            both = F.greatest(local, before)
        elif kind == "min":
            both = F.least(local, before)
        elif kind == "sum":
            both = F.coalesce(local, F.lit(0)) + F.coalesce(before, F.lit(0))
        else:
            both = F.coalesce(local, before)
        out = out.withColumn(target, both)
    return out.drop("__blk", *tmp, *[f"__c{n}" for n in tmp])


def _running(kind: str, col: Column) -> Column:
    return {
        "max": F.max(col),
        "min": F.min(col),
        "sum": F.sum(col),
        "last": F.last(col, ignorenulls=True),
    }[kind]


def with_halo(df: DataFrame, t: str, halo: int, block: int = BLOCK) -> DataFrame:
    """Copy rows within ``halo`` of a block edge into the neighbouring blocks.

    Adds ``__blk`` (the block to window in) and ``__own`` (true for the row's
    home block).  Window over ``keys + __blk``, then keep ``__own`` rows.
    """
    lo, hi = block_of(F.col(t) - halo, block), block_of(F.col(t) + halo, block)
    return df.withColumn("__blk", F.explode(F.sequence(lo, hi))).withColumn(
        "__own", F.col("__blk") == block_of(t, block)
    )


def own_rows(df: DataFrame) -> DataFrame:
    return df.filter("__own").drop("__blk", "__own")


_PARTIAL = {"max": F.max, "min": F.min, "sum": F.sum, "list": F.collect_list}


def islands(
    df: DataFrame,
    keys: Sequence[str],
    start: str,
    end: str,
    gap: Column | float = 0,
    inclusive: bool = True,
    aggs: dict[str, tuple[str, Column]] | None = None,
    distinct: bool = False,
) -> DataFrame:
    """One row per distinct start, with the island it belongs to.

    A start joins the running island when ``start - running_end <= gap``
    (``< gap`` with ``inclusive=False``).  Returns ``keys, start, __end,
    island`` (the island's first start) plus the aggregates in ``aggs``
    (``max min sum list``).  ``distinct`` promises one row per start already.
    """
    if distinct:
        pts = df.select(*keys, start, F.col(end).alias("__end"), *[x.alias(n) for n, (_, x) in (aggs or {}).items()])
    else:
        pts = df.groupBy(*keys, start).agg(
            F.max(end).alias("__end"), *[_PARTIAL[k](expr).alias(name) for name, (k, expr) in (aggs or {}).items()]
        )
    pts = carry(pts, keys, start, {"__prev": ("max", F.col("__end"))})
    dist = F.col(start) - F.col("__prev")
    joined = (dist <= gap) if inclusive else (dist < gap)
    pts = pts.withColumn("__open", F.when(F.col("__prev").isNull() | ~joined, F.col(start)))
    upto = W.partitionBy(*keys).orderBy(start).rowsBetween(W.unboundedPreceding, 0)
    return pts.withColumn("island", F.max("__open").over(upto)).drop("__prev", "__open")


def merge_spans(
    df: DataFrame,
    keys: Sequence[str],
    start: str,
    end: str,
    gap: float = 0,
    inclusive: bool = True,
    aggs: dict[str, tuple[str, Column]] | None = None,
    distinct: bool = False,
) -> DataFrame:
    """Merge spans into islands; ``aggs`` are combined across members."""
    pts = islands(df, keys, start, end, gap, inclusive, aggs, distinct)
    final = []
    for name, (kind, _) in (aggs or {}).items():
        if kind == "list" and not distinct:
            final.append(F.flatten(F.collect_list(name)).alias(name))
        else:
            final.append(_PARTIAL[kind](F.col(name)).alias(name))
    return pts.groupBy(*keys, "island").agg(F.max("__end").alias(end), *final).withColumnRenamed("island", start)


def span_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    l_span: tuple[str, str],
    r_span: tuple[str, str],
    block: int = BLOCK,
) -> DataFrame:
    """Inner join of spans sharing a point (closed ends), one row per pair.

    Both sides are placed in every block they touch; a pair is kept only in the
    first block both share, so no de-duplication is needed.  Column names of
    the two sides must differ apart from ``keys``.
    """
    ls, le = l_span
    rs, re_ = r_span
    lb = left.withColumn("__l0", block_of(ls, block)).withColumn(
        "__blk", F.explode(F.sequence(F.col("__l0"), F.greatest(F.col("__l0"), block_of(le, block))))
    )
    rb = right.withColumn("__r0", block_of(rs, block)).withColumn(
        "__blk", F.explode(F.sequence(F.col("__r0"), F.greatest(F.col("__r0"), block_of(re_, block))))
    )
    return (
        lb.join(rb, [*keys, "__blk"])
        .filter(
            (F.col("__blk") == F.greatest("__l0", "__r0"))
            & (F.col(ls) <= F.col(re_))
            & (F.col(rs) <= F.col(le))
        )
        .drop("__blk", "__l0", "__r0")
    )


def point_join(
    spans: DataFrame,
    points: DataFrame,
    keys: Sequence[str],
    span: tuple[str, str],
    t: str,
    block: int = BLOCK,
) -> DataFrame:
    """Inner join of spans with the points inside them (closed ends)."""
    s, e = span
    sb = spans.filter(F.col(e) >= F.col(s)).withColumn(
        "__blk", F.explode(F.sequence(block_of(s, block), block_of(e, block)))
    )
    pb = points.withColumn("__blk", block_of(t, block))
    return (
        sb.join(pb, [*keys, "__blk"])
        .filter((F.col(t) >= F.col(s)) & (F.col(t) <= F.col(e)))
        .drop("__blk")
    )
