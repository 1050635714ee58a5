"""Exact order statistics by refining histograms, globally or per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..blocks import cut

#: buckets a round, and values from which on a range is refined
BUCKETS, FEW = 256, 4096


def selected(df: DataFrame, value: str, keys: Sequence[str], positions: dict[str, Column], few: int = FEW) -> DataFrame:
    """Value at zero-based positions of each group's order, one column per position.

    ``positions`` are expressions over an aggregation (``F.count("*")``); a position
    beyond the group gives null.  Each round counts the values of a range in buckets (which
    combines on the map side), descends into the bucket that holds the position and keeps
    the values in it; equal values share a bucket, and a range of one value is settled.
    A group is ordered only once at most ``few`` of its values are left per position,
    so neither a window nor a sort runs over a group.  ``df`` is read in each round: write
    it first (``cut``) if it is costly.
    """
    keys = list(keys)
    x = df.select(*keys, F.col(value).cast("double").alias("__v")).filter(F.col("__v").isNotNull() & ~F.isnan("__v"))
    names = list(positions)
    wanted = F.array(*[F.struct(F.lit(k).alias("__q"), p.cast("long").alias("__at")) for k, p in enumerate(positions.values())])
    info = x.groupBy(*keys).agg(wanted.alias("__w"), F.count("*").alias("__n"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi"))
    asks = cut(info.select(*keys, F.explode("__w").alias("w"), "__n", "__lo", "__hi").select(*keys, "w.*", "__n", "__lo", "__hi"))
    done = None
    group = [*keys, "__q"]
    while True:
        # ranges of one value, and positions outside, are settled
        over = (F.col("__lo") == F.col("__hi")) | (F.col("__at") >= F.col("__n")) | (F.col("__at") < 0)
        now = asks.filter(over).select(*group, F.when((F.col("__at") < F.col("__n")) & (F.col("__at") >= 0), F.col("__lo")).alias("__value"))
        done = now if done is None else done.unionByName(now)
        open_ = asks.filter(~over)
        small = open_.filter(F.col("__n") <= few)
        inside = _inside(x, small, keys).groupBy(*group).agg(F.array_sort(F.collect_list("__v")).alias("__all"), F.first("__at").alias("__at"))
        done = done.unionByName(inside.select(*group, F.get("__all", F.col("__at")).alias("__value")))
        large = open_.filter(F.col("__n") > few)
        if large.isEmpty():
            break
        width = (F.col("__hi") - F.col("__lo")) / BUCKETS
        held = _inside(x, large, keys).withColumn("__b", F.least(F.floor((F.col("__v") - F.col("__lo")) / width), F.lit(BUCKETS - 1)))
        counts = held.groupBy(*group, "__b").agg(F.count("*").alias("__n"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi"), F.first("__at").alias("__at"))
        per = counts.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("__b", "__n", "__lo", "__hi"))).alias("__h"), F.first("__at").alias("__at"))
        seek = F.aggregate(
            "__h",
            F.struct(F.col("__at").alias("at"), F.lit(None).cast("struct<__b:bigint,__n:bigint,__lo:double,__hi:double>").alias("hit")),
            lambda acc, b: F.when(acc["hit"].isNotNull(), acc).when(acc["at"] < b["__n"], F.struct(acc["at"].alias("at"), b.alias("hit"))).otherwise(F.struct((acc["at"] - b["__n"]).alias("at"), acc["hit"].alias("hit"))),
        )
        asks = cut(per.withColumn("s", seek).select(*group, F.col("s.at").alias("__at"), "s.hit.__n", "s.hit.__lo", "s.hit.__hi"))
    out = done.groupBy(*keys).agg(*[F.max(F.when(F.col("__q") == k, F.col("__value"))).alias(name) for k, name in enumerate(names)])
    return out


def medians(df: DataFrame, value: str, keys: Sequence[str], out: str, few: int = FEW) -> DataFrame:
    """Median of each group: the mean of the two middle values."""
    n = F.count("*")
    x = selected(df, value, keys, {"__a": F.floor((n - 1) / 2), "__b": F.floor(n / 2)}, few)
    return x.select(*keys, ((F.col("__a") + F.col("__b")) / 2).alias(out))


def _inside(x: DataFrame, asks: DataFrame, keys: list[str]) -> DataFrame:
    """Values within the range of each open position; ranges are few, one a group and position."""
    between = F.col("__v").between(F.col("__lo"), F.col("__hi"))
    if not keys:
        return x.crossJoin(F.broadcast(asks)).filter(between)  # a row for each position asked for
    return x.join(asks, keys).filter(between)
