"""Choosing frames, labels and splits for training."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..blocks import BLOCK, point_join, positions
from ..functions.text import teams_match


def hard_negatives(
    feat: DataFrame, gt: DataFrame, n: int, buffer: int = 5, min_conf: float = 0.30, opponents: DataFrame | None = None
) -> DataFrame:
    """The ``n`` most goal-like seconds away from any shot, over all recordings with truth.

    ``opponents`` (vid, opponent) limits the shots to those of that team; recordings
    without an opponent there keep all.
    """
    feat = feat.join(gt.select("vid").distinct(), "vid", "left_semi")
    shots = gt.filter(F.lower(F.trim("action")) == "shots")
    if opponents is not None:
        shots = shots.join(opponents.select("vid", "opponent"), "vid", "left")
        shots = shots.filter((F.coalesce("opponent", F.lit("")) == "") | teams_match(F.col("team"), F.col("opponent")))
    near = shots.select(
        "vid", F.explode(F.sequence((F.floor("start_s") - buffer).cast("int"), (F.floor("end_s") + buffer).cast("int"))).alias("t")
    ).distinct()
    x = feat.filter((F.col("n_goal") >= 1) & (F.col("goal_conf_max") >= min_conf)).join(near, ["vid", "t"], "left_anti")
    score = F.col("goal_conf_max") * F.when(F.col("n_player") >= 5, 1.0).otherwise(0.5) * F.when(F.col("n_goalie") >= 1, 1.0).otherwise(0.7)
    return x.select("vid", "t", score.alias("score")).orderBy(F.desc("score"), F.desc(F.col("vid").cast("string")), F.desc("t")).limit(n)


def best_second(gt: DataFrame, series: DataFrame, keep: float = 0.25, block: int = BLOCK) -> DataFrame:
    """Most confident second of each shot, the first on ties.

    ``series`` has ``(vid, t, conf)``; shots below ``keep`` are left out.
    """
    n = series.groupBy("vid").agg((F.max("t") + 1).alias("__dur"))
    spans = gt.filter(F.lower(F.trim("action")) == "shots").join(n, "vid").select(
        "vid", F.greatest(F.col("start_s"), F.lit(0)).alias("a"), F.least(F.col("end_s"), F.col("__dur") - 1).alias("b"), "start_s", "end_s"
    ).distinct()
    hit = point_join(spans, series, ["vid"], ("a", "b"), "t", block)
    return (
        hit.groupBy("vid", "start_s", "end_s")
        .agg(F.max_by("t", F.struct("conf", -F.col("t"))).alias("t"), F.max("conf").alias("conf"))
        .filter(F.col("conf") >= keep)
    )


def stratified_split(counts: DataFrame, frac: float = 0.25, min_test: int = 3) -> DataFrame:
    """Hold-out spanning the count range: every k-th game by count.

    The picked ids are cut to the wanted number after sorting them by id.
    ``counts`` has ``(vid, n)``; ids may be of any type that sorts.
    """
    size = counts.agg(F.count("*").alias("__n"))
    want = F.least(F.greatest(F.lit(min_test), F.bround(F.col("__n") * F.lit(frac), 0)), F.col("__n") - 1).cast("long")
    size = size.withColumn("__want", want).withColumn("__step", F.greatest(F.floor(F.col("__n") / F.col("__want")), F.lit(1)))
    x = positions(counts, ["n", "vid"]).crossJoin(size)  # one row
    picked = x.filter(F.col("__i") % F.col("__step") == 0).drop("__i")
    test = positions(picked, ["vid"]).filter(F.col("__i") < F.col("__want")).select("vid", F.lit("test").alias("__s"))
    return counts.join(test, "vid", "left").withColumn("split", F.coalesce("__s", F.lit("train"))).drop("__s")


def train_subset(pool: DataFrame, n: int) -> DataFrame:
    """The first ``n`` ids of the training pool."""
    return pool.orderBy("vid").limit(n)


def hash_bucket(key: Column, seed: str = "split-v1") -> Column:
    """Stable position of a key in [0, 1)."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), key)), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def hash_split(df: DataFrame, key: str, frac: float, seed: str = "split-v1") -> DataFrame:
    return df.withColumn("split", F.when(hash_bucket(F.col(key), seed) < frac, "val").otherwise("train"))


def dataset(frames: DataFrame, labels: DataFrame, vids: DataFrame) -> DataFrame:
    """Frames of the training recordings that have a label."""
    return frames.join(vids.select("vid"), "vid", "left_semi").join(labels, ["vid", "t"])


def autolabel(boxes: DataFrame, goal: str = "goal", shot: str = "shot", wf: float = 2.0, hf: float = 1.5) -> DataFrame:
    """Derived shot box per frame from its first goal box.

    ``boxes``: ``(vid, t, line_no, cls, cx, cy, w, h)``.  Returns one row per
    frame with ``status``: ``already_labelled``, ``no_goal`` or ``labelled``.
    """
    first = F.min_by(F.when(F.col("cls") == goal, F.struct("cx", "cy", "w", "h")), F.when(F.col("cls") == goal, F.col("line_no")))
    g = boxes.groupBy("vid", "t").agg(F.max((F.col("cls") == shot).cast("int")).alias("__has"), first.alias("__g"))
    status = F.when(F.col("__has") == 1, "already_labelled").when(F.col("__g").isNull(), "no_goal").otherwise("labelled")
    x = g.withColumn("status", status)
    nw, nh = F.least(F.lit(1.0), F.col("__g.w") * wf), F.least(F.lit(1.0), F.col("__g.h") * hf)
    centre = lambda c, n: F.greatest(n / 2, F.least(1 - n / 2, F.col(f"__g.{c}")))
    ok = F.col("status") == "labelled"
    return x.select(
        "vid", "t", "status", F.when(ok, centre("cx", nw)).alias("cx"), F.when(ok, centre("cy", nh)).alias("cy"),
        F.when(ok, nw).alias("w"), F.when(ok, nh).alias("h"),
    )


def sample_times(df: DataFrame, n: int, margin: float = 30.0, duration: str = "duration") -> DataFrame:
    """``n`` evenly spaced times between both margins."""
    step = (F.col(duration) - 2 * margin) / (n - 1)
    return df.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("t", F.lit(margin) + F.col("i") * step)
