"""Per-second features and summaries from object detections (one row per box)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.spans import box_center, boxes_overlap, expand_box
from ..functions.stats import ratio

#: counts of classes without further features; the first class is spelt as the detector spells it (fixed names)
OTHERS = {"n_centroid": "centriod", "n_faceoff": "faceoff", "n_referee": "referee"}


def _pairs(det: DataFrame, a: str, b: str, diag: float) -> DataFrame:
    """Nearest distance and overlap flags between two classes of a frame."""
    box = ("x1", "y1", "x2", "y2")
    left = det.filter(F.col("cls") == a).select("vid", "t", *[F.col(c).alias(f"a_{c}") for c in box]).distinct()
    right = det.filter(F.col("cls") == b).select("vid", "t", *[F.col(c).alias(f"b_{c}") for c in box]).distinct()
    pa, pb = [F.col(f"a_{c}") for c in box], [F.col(f"b_{c}") for c in box]
    dist = F.hypot(box_center(pa[0], pa[2]) - box_center(pb[0], pb[2]), box_center(pa[1], pa[3]) - box_center(pb[1], pb[3]))
    wide = expand_box(*pb, 2.0)
    # a frame holds a handful of boxes per class; equal boxes are compared once
    return left.join(right, ["vid", "t"]).groupBy("vid", "t").agg(
        (F.min(dist) / diag).alias("dist"), F.max(boxes_overlap(*pa, *pb).cast("int")).alias("inside"), F.max(boxes_overlap(*pa, *wide).cast("int")).alias("inside2")
    )


def detection_features(det: DataFrame, frames: DataFrame, diag: float) -> DataFrame:
    """One row per frame: counts, confidences, distances and overlap flags.

    A frame without boxes has zeros everywhere; boxes without the needed pair
    leave the distance null.
    """
    n = lambda c: F.count_if(F.col("cls") == c)
    conf = lambda c: F.when(F.col("cls") == c, F.col("conf"))
    g = det.groupBy("vid", "t").agg(
        n("puck").alias("n_puck"), F.max(conf("puck")).alias("puck_conf_max"), F.avg(conf("puck")).alias("puck_conf_mean"),
        n("goal").alias("n_goal"), F.max(conf("goal")).alias("goal_conf_max"), n("goalie").alias("n_goalie"),
        F.max(conf("goalie")).alias("goalie_conf_max"), n("player").alias("n_player"), *[n(c).alias(name) for name, c in OTHERS.items()], F.lit(True).alias("__any"),
    )
    pg, kg = _pairs(det, "puck", "goal", diag), _pairs(det, "goalie", "goal", diag)
    x = frames.select("vid", "t").join(g, ["vid", "t"], "left")
    x = x.join(pg.withColumnRenamed("dist", "puck_goal_min"), ["vid", "t"], "left")
    x = x.join(kg.select("vid", "t", F.col("dist").alias("goalie_goal_min")), ["vid", "t"], "left")
    zero = ["n_puck", "n_goal", "n_goalie", "n_player", *OTHERS, "inside", "inside2"]
    x = x.na.fill(0, zero).na.fill(0.0, ["puck_conf_max", "puck_conf_mean", "goal_conf_max", "goalie_conf_max"])
    for c in ("puck_goal_min", "goalie_goal_min"):
        x = x.withColumn(c, F.when(F.col("__any").isNull(), F.lit(0.0)).otherwise(F.col(c)))
    return x.withColumnRenamed("inside", "puck_in_goal").withColumnRenamed("inside2", "puck_in_goal_ext2").drop("__any")


def class_series(det: DataFrame, shot: str = "puck", goal: str = "goal") -> DataFrame:
    """Per-second top confidence and count of the shot class, top goal confidence."""
    conf = lambda c: F.coalesce(F.max(F.when(F.col("cls") == c, F.col("conf"))), F.lit(0.0))
    return det.groupBy("vid", "t").agg(
        conf(shot).alias("shot_max_conf"), F.count_if(F.col("cls") == shot).alias("shot_n"), conf(goal).alias("goal_max_conf")
    )


def detection_summary(det: DataFrame, frames: DataFrame, classes=("goal", "goalie", "player")) -> DataFrame:
    """Frames with each class, total boxes and the share of sampled frames."""
    per_frame = det.groupBy("vid", "t").agg(*[F.count_if(F.col("cls") == c).alias(f"n_{c}") for c in classes])
    g = per_frame.groupBy("vid").agg(
        *[F.count_if(F.col(f"n_{c}") > 0).alias(f"frames_with_{c}") for c in classes], *[F.sum(f"n_{c}").alias(f"total_{c}") for c in classes]
    )
    n = frames.groupBy("vid").agg(F.count(F.col("t")).alias("n_samples"))
    x = n.join(g, "vid", "left").na.fill(0)
    return x.select("*", *[ratio(100 * F.col(f"frames_with_{c}"), F.col("n_samples"), 0, None).alias(f"pct_{c}") for c in classes])
