"""Segment assembly: raw windows to the final, target-only timeline."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..blocks import BLOCK, cut
from ..operators import attribution as A, intervals as I


@dataclass(frozen=True)
class AssemblyConfig:
    """Thresholds in seconds (fixed defaults)."""

    min_threat: int = 15
    max_threat: int = 60
    min_keep: int = 5
    opening: int = 20
    faceoff: float = 0.8
    target_only: bool = True
    block: int = BLOCK


def assemble(
    raw: DataFrame, sig: DataFrame, games: DataFrame, cfg: AssemblyConfig = AssemblyConfig(), net: DataFrame | None = None
) -> DataFrame:
    """All recordings in one job.

    Attribute, drop short and opening windows, merge, cover the timeline,
    merge neighbours, split long threats, demote slivers, merge again, cut at
    period edges, assign sides and keep the target's threats.
    """
    lengths = cut(sig.groupBy("vid").agg((F.max("t") + 1).alias("dur")))
    periods = games.select("vid", F.explode("periods").alias("p")).select(
        "vid", F.col("p.start").alias("p_start"), F.col("p.end").alias("p_end")
    )
    # windows and segments are tiny next to the signals they come from, and the
    # steps below read them several times, so they are written three times, and so are the lengths
    x = cut(A.attribute(raw, sig, games, net, cfg.block, lengths=lengths))
    x = I.min_duration(x, cfg.min_threat)
    x = I.drop_opening_fp(x, sig.filter(F.col("faceoff") >= cfg.faceoff).select("vid", "t"), cfg.opening)
    x = x.select("vid", "start_s", "end_s", F.lit(True).alias("threat"), "color", F.col("win_id").alias("ord"))
    x = cut(I.merge_classified(x))
    x = I.cover(x, lengths)
    x = I.merge_adjacent(x, cfg.max_threat)
    x = I.split_long(x, cfg.max_threat)
    x = I.demote_short(x, cfg.min_keep)
    x = cut(I.merge_adjacent(x, cfg.max_threat))
    x = I.split_periods(x, periods, cfg.block)
    x = A.apply_sides(x, games)
    return I.target_filter(x, games) if cfg.target_only else x


def run_meta(seg: DataFrame) -> DataFrame:
    """Segment counts and threat seconds by colour, per recording."""
    by_color = seg.filter("threat and color is not null").groupBy("vid", "color").agg(F.sum(F.col("end_s") - F.col("start_s")).alias("s"))
    maps = by_color.groupBy("vid").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("color", "s")))).alias("threat_duration_by_color"))
    n = seg.groupBy("vid").agg(
        F.count("*").alias("total_segments"), F.count_if("threat").alias("threat_segments"), F.count_if(~F.col("threat")).alias("no_threat_segments")
    )
    return n.join(maps, "vid", "left")
