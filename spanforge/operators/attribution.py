"""Which goalie a window threatens: side maps, motion, detections, inheritance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..blocks import BLOCK, carry, point_join
from ..functions.stats import mean_in_order
from ..functions.text import order_colors
from .intervals import as_of

KEYS = ["vid"]


def _sides(games: DataFrame) -> DataFrame:
    norm = lambda c: F.lower(F.trim(F.col(c)))
    x = games.withColumn("__ts", norm("target_side")).withColumn("__os", norm("opponent_side"))
    ok = F.col("__ts").isin("left", "right") & F.col("__os").isin("left", "right") & (F.col("__ts") != F.col("__os"))
    return x.withColumn("__ok", F.coalesce(ok, F.lit(False)))


def period_sides(games: DataFrame) -> DataFrame:
    """Side of both goalies from each period start; sides alternate.

    Needs two valid, different start sides and a target colour.  Without an
    entry at zero the first period's sides also hold from zero.
    """
    x = _sides(games).filter("__ok and target_color is not null and target_color <> ''")
    starts = F.array_sort(F.filter(F.transform("periods", lambda p: p["start"].cast("int")), lambda s: s.isNotNull()))
    x = x.withColumn("__s", starts).filter(F.size("__s") > 0)
    entries = F.transform(
        "__s",
        lambda s, i: F.struct(
            s.alias("start_t"), (i + 1).alias("num"),
            F.when(i % 2 == 0, F.col("__ts")).otherwise(F.col("__os")).alias("target_side"),
            F.when(i % 2 == 0, F.col("__os")).otherwise(F.col("__ts")).alias("opponent_side"),
        ),
    )
    first = F.struct(
        F.lit(0).alias("start_t"), F.lit(0).alias("num"), F.col("__ts").alias("target_side"), F.col("__os").alias("opponent_side")
    )
    both = F.when(F.get("__s", F.lit(0)) > 0, F.concat(F.array(first), entries)).otherwise(entries)
    return x.select("vid", F.explode(both).alias("p")).select("vid", "p.*")


def _colors(games: DataFrame) -> DataFrame:
    a, b = order_colors(F.col("target_color"), F.col("opponent_color"))
    return _sides(games).select(
        "vid", F.col("target_color").alias("__tc"), F.col("opponent_color").alias("__oc"), a.alias("color_a"), b.alias("color_b"),
        F.when(F.col("__ok"), F.col("__ts")).alias("__ts0"), F.when(F.col("__ok"), F.col("__os")).alias("__os0"),
    )


def _with_map(seg: DataFrame, games: DataFrame, t: str = "start_s") -> DataFrame:
    """Sides in force at ``t``: the latest period map, else the start sides."""
    x = as_of(seg, period_sides(games), t, "start_t", "__m", rank=[F.col("num")])
    x = x.join(_colors(games), "vid", "left")
    return x.withColumn("__t", F.coalesce("__m.target_side", "__ts0")).withColumn("__o", F.coalesce("__m.opponent_side", "__os0"))


def _side_of(color: Column) -> Column:
    return F.when(color == F.col("__oc"), F.col("__o")).when(color == F.col("__tc"), F.col("__t"))


_TMP = ("__m", "__tc", "__oc", "__ts0", "__os0", "__t", "__o")


def apply_sides(seg: DataFrame, games: DataFrame) -> DataFrame:
    """Side of the threatened goalie at each segment's start; null without threat."""
    x = _with_map(seg, games)
    on = F.col("threat") & F.col("color").isNotNull()
    return x.withColumn("side", F.when(on, _side_of(F.col("color")))).drop(*_TMP, "color_a", "color_b")


def motion_side(
    win: DataFrame, sig: DataFrame, pre: int = 10, ratio: float = 1.15, floor: float = 0.5, block: int = BLOCK
) -> DataFrame:
    """Mean left/right motion from ``pre`` s before a window to its end.

    A side is named when the means differ by ``floor`` and by ``ratio``.
    Windows with equal bounds are looked up once.  Means add up in time order, so a
    difference right at ``floor`` falls the same way however the rows are dealt.
    """
    spans = win.filter("end_s > start_s").select("vid", "start_s", "end_s").distinct()
    spans = spans.withColumn("__a", F.greatest(F.col("start_s") - pre, F.lit(0))).withColumn("__b", F.col("end_s") - 1)
    means = (
        point_join(spans, sig.select("vid", "t", "motion_left", "motion_right"), KEYS, ("__a", "__b"), "t", block)
        .groupBy("vid", "start_s", "end_s")
        .agg(mean_in_order("motion_left", "t").alias("mean_left"), mean_in_order("motion_right", "t").alias("mean_right"))
    )
    x = win.join(means, ["vid", "start_s", "end_s"], "left").na.fill(0.0, ["mean_left", "mean_right"])
    l_, r = F.col("mean_left"), F.col("mean_right")
    far = F.abs(r - l_) >= floor
    rt = F.when(far, F.greatest(l_, r) / F.greatest(F.least(l_, r), F.lit(1e-6))).otherwise(F.lit(1.0))
    side = F.when(far & (rt >= ratio), F.when(r > l_, "right").otherwise("left")).otherwise("ambiguous")
    return x.withColumn("motion_ratio", rt).withColumn("attacked_side", side)


def attribute(
    win: DataFrame, sig: DataFrame, games: DataFrame, net: DataFrame | None = None, block: int = BLOCK, id_block: int = 2000,
    lengths: DataFrame | None = None,
) -> DataFrame:
    """Colour and side for every window, best evidence first.

    Confident detection, clear motion, any edge in motion, the previous
    window's colour (in arrival order ``win_id``), the first colour.
    ``net`` may carry ``(vid, win_id, net_side, net_label)``.  Windows end with the
    last second of the recording; those that start after it are dropped.  ``lengths``
    (``vid, dur``) spares the pass over the signals that finds it.
    """
    lengths = sig.groupBy("vid").agg((F.max("t") + 1).alias("dur")) if lengths is None else lengths
    length = lengths.select("vid", F.col("dur").cast("int").alias("__dur"))
    win = win.select("vid", "win_id", "start_s", "end_s", "source").join(length, "vid", "left")
    win = win.withColumn("end_s", F.least("end_s", "__dur")).drop("__dur").filter("end_s > start_s")
    x = _with_map(motion_side(win, sig, block=block), games)
    if net is not None:
        x = x.join(net.select("vid", "win_id", "net_side", "net_label"), ["vid", "win_id"], "left")
    else:
        x = x.withColumn("net_side", F.lit(None).cast("string")).withColumn("net_label", F.lit(None).cast("string"))
    l_, r = F.col("mean_left"), F.col("mean_right")
    clear = F.when(F.col("attacked_side") != "ambiguous", F.col("attacked_side"))
    edge = F.when(r > l_, "right").when(l_ > r, "left")
    side = F.coalesce("net_side", clear, edge)
    src = (
        F.when(F.col("net_side").isNotNull(), F.concat(F.lit("net_"), F.col("net_label")))
        .when(clear.isNotNull(), F.lit("motion"))
        .when(edge.isNotNull(), F.lit("fallback_motion_edge"))
    )
    a, b = F.col("color_a"), F.col("color_b")
    defending = F.when(_side_of(a) == side, a).when(_side_of(b) == side, b).otherwise(a)
    x = x.withColumn("__side", side).withColumn("__src", src).withColumn("__col", F.when(side.isNotNull(), defending))
    x = carry(
        x, KEYS, "win_id",
        {"__pc": ("last", F.col("__col")), "__ps": ("last", F.col("__side")), "__n": ("sum", F.lit(1))},
        block=id_block,
    )
    color = F.coalesce("__col", "__pc", a)
    side2 = F.coalesce("__side", _side_of(color), "__ps", F.lit("left"))
    first = F.col("__n") == 0
    return x.select(
        "vid", "win_id", "start_s", "end_s", "source", color.alias("color"), side2.alias("side"),
        F.bround(F.round("mean_left", 8), 3).alias("motion_left"), F.bround(F.round("mean_right", 8), 3).alias("motion_right"),
        F.bround(F.round("motion_ratio", 6), 2).alias("motion_ratio"),
        F.coalesce("__src", F.when(first, "fallback_default_a").otherwise("fallback_inherit_prev")).alias("attribution_src"),
    )


def side_vote(
    win: DataFrame, det: DataFrame, frame_w: float, min_frames: int = 2, majority: float = 0.66, block: int = BLOCK
) -> DataFrame:
    """Window side from per-frame detections of goal and goalie.

    A frame votes with the side of its most confident box per class.  Frames
    showing both on one side come first, then goalie only, then goal only.
    """
    side = F.when((F.col("x1") + F.col("x2")) / 2 < frame_w / 2, "left").otherwise("right")
    top = lambda c: F.max_by(F.when(F.col("cls") == c, side), F.when(F.col("cls") == c, F.struct("conf", -F.col("box_no"))))
    frames = det.groupBy("vid", "t").agg(top("goal").alias("g"), top("goalie").alias("k"))
    kind = (
        F.when(F.col("g") == F.col("k"), "cooccur")
        .when(F.col("k").isNotNull() & F.col("g").isNull(), "goalie_only")
        .when(F.col("g").isNotNull() & F.col("k").isNull(), "goal_only")
    )
    frames = frames.withColumn("kind", kind).withColumn("vote", F.coalesce("k", "g"))
    spans = win.select("vid", "start_s", "end_s").distinct().withColumn("__b", F.col("end_s") - 1)
    n = {}
    for k in ("cooccur", "goalie_only", "goal_only"):
        n[f"n_{k}"] = F.count_if(F.col("kind") == k)
        n[f"l_{k}"] = F.count_if((F.col("kind") == k) & (F.col("vote") == "left"))
    x = point_join(spans, frames, KEYS, ("start_s", "__b"), "t", block).groupBy("vid", "start_s", "end_s").agg(
        F.count("*").alias("n_frames"), *[c.alias(k) for k, c in n.items()]
    )

    def winner(k):
        total, left = F.col(f"n_{k}"), F.col(f"l_{k}")
        return F.when(
            total >= min_frames,
            F.when(left / total >= majority, "left").when((total - left) / total >= majority, "right"),
        )

    order = ["cooccur", "goalie_only", "goal_only"]
    label = F.lit("none")
    for k in reversed(order):
        label = F.when(winner(k).isNotNull(), F.lit(k)).otherwise(label)
    return x.select(
        "vid", "start_s", "end_s", "n_frames", *[f"n_{k}" for k in order], F.coalesce(*[winner(k) for k in order]).alias("net_side"), label.alias("net_label")
    )
