"""Count errors, sweeps, comparisons and confidence intervals."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..blocks import carry, cut, positions
from ..functions.stats import f1, ratio
from ..operators.identity import restrict_gt

#: rows of a part when resampling, and draws hashed at once
PART, DRAWS = 16_384, 1 << 21


def _errors(d: Column, suffix: str) -> list[Column]:
    return [
        F.bround(F.avg(F.abs(d)), 3).alias(f"mae{suffix}"), F.bround(F.sqrt(F.avg(d * d)), 3).alias(f"rmse{suffix}"),
        F.bround(F.avg(d), 3).alias(f"bias{suffix}"), F.bround(100 * F.avg((d == 0).cast("int")), 1).alias(f"exact_pct{suffix}"),
    ]


def count_error(win: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """MAE, RMSE, bias and exact share of shot counts per window."""
    d, du = F.col("pred_shots") - F.col("gt_shots"), F.col("pred_shots") - F.col("gt_shots_unfiltered")
    return win.groupBy(*by).agg(F.count("*").alias("n"), *_errors(d, ""), *_errors(du, "_unfiltered"))


def goal_confusion(win: DataFrame, by: Sequence[str] = (), actual: str = "gt_goals") -> DataFrame:
    """Goal-in-window as a binary classifier; ratios are null when undefined."""
    a, p = F.col(actual) >= 1, F.col("pred_goals") >= 1
    x = win.groupBy(*by).agg(
        F.count_if(a & p).alias("tp"), F.count_if(~a & p).alias("fp"), F.count_if(a & ~p).alias("fn"), F.count_if(~a & ~p).alias("tn")
    )
    pr, rc = ratio(F.col("tp"), F.col("tp") + F.col("fp"), None, None), ratio(F.col("tp"), F.col("tp") + F.col("fn"), None, None)
    return x.select("*", F.bround(pr, 4).alias("precision"), F.bround(rc, 4).alias("recall"), F.bround(F.when(pr + rc > 0, f1(pr, rc)), 4).alias("f1"))


def metric_summary(win: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Totals, difference and ratio of predicted against true counts."""
    names = ("pred_shots", "gt_shots", "gt_shots_unfiltered", "pred_goals", "gt_goals", "gt_goals_unfiltered")
    x = win.groupBy(*by).agg(F.count("*").alias("n_windows"), *[F.sum(c).alias(c) for c in names])
    c = F.col
    return x.select(
        "*", (c("pred_shots") - c("gt_shots")).alias("shots_diff"), ratio(c("pred_shots"), c("gt_shots"), 3, None).alias("shots_ratio"),
        (c("pred_goals") - c("gt_goals")).alias("goals_diff"), (c("pred_shots") - c("gt_shots_unfiltered")).alias("shots_diff_unfiltered"),
        ratio(c("pred_shots"), c("gt_shots_unfiltered"), 3, None).alias("shots_ratio_unfiltered"),
    )


def shot_summary(counts: DataFrame) -> DataFrame:
    """Pooled strict, lenient and within-coverage shot scores."""
    cols = ("n_pred", "n_gt", "n_covered", "tp_strict", "tp_lenient", "fp", "fn", "fn_uncovered")
    x = counts.agg(F.count("*").alias("n_videos"), *[F.sum(c).alias(c) for c in cols])
    tp = F.col("tp_strict")
    p, r, rw = ratio(tp, tp + F.col("fp"), None), ratio(tp, F.col("n_gt"), None), ratio(tp, F.col("n_covered"), None)
    return x.select(
        "*", F.bround(p, 4).alias("precision"), F.bround(r, 4).alias("recall"), F.bround(rw, 4).alias("recall_within_coverage"),
        F.bround(f1(p, r), 4).alias("f1"), F.bround(f1(p, rw), 4).alias("f1_within_coverage"),
    )


def event_totals(gt: DataFrame, tmap: DataFrame, meta: DataFrame) -> DataFrame:
    """Shots and goals of each game; only the opponent's where the prediction was target-filtered.

    ``meta`` has ``(vid, applied)``.  A game whose teams share a colour, or without a map, counts all events.
    """
    opponents = tmap.filter("is_opponent and not collision").select("vid", F.col("team").alias("opponent_team"))
    x = restrict_gt(gt, opponents, meta)
    return x.groupBy("vid").agg(F.count_if(F.col("action") == "Shots").alias("game_shots"), F.count_if(F.col("action") == "Goals").alias("game_goals"))


def evaluate_counts(win: DataFrame, shots: DataFrame, totals: DataFrame, refined: DataFrame) -> DataFrame:
    """Per-game counts report: window totals and errors, shot scores, game totals (``event_totals``) and refinement (``refine_summary``)."""
    w = metric_summary(win, ["vid"]).join(count_error(win, ["vid"]).drop("n"), "vid")
    w = w.join(shots.select("vid", "tp_strict", "tp_lenient", "fp", "fn", "fn_uncovered"), "vid", "left").join(totals, "vid", "left")
    return w.join(refined.select("vid", "n_refined", "orig_width_median", "refined_width_median", "median_shrinkage"), "vid", "left")


def tick_prf(df: DataFrame, thr: float = 0.5, by: Sequence[str] = ("vid",)) -> DataFrame:
    """Per-second precision, recall and F1; denominators are at least one."""
    hot, pos = F.col("p") > thr, F.col("label") == 1
    x = df.groupBy(*by).agg(F.count_if(hot & pos).alias("tp"), F.count_if(hot & ~pos).alias("fp"), F.count_if(~hot & pos).alias("fn"))
    one = F.lit(1)
    p = F.col("tp") / F.greatest(one, F.col("tp") + F.col("fp"))
    r = F.col("tp") / F.greatest(one, F.col("tp") + F.col("fn"))
    return x.select("*", p.alias("p"), r.alias("r"), f1(p, r).alias("f1"))


def auc(df: DataFrame, by: str = "vid", step: float = 1 / 1024) -> DataFrame:
    """Rank-sum AUC per game; equal scores share their average rank.

    Equal scores are counted first.  The running count of negatives is taken in
    score steps of ``step`` and over one sum per step, so no game is ordered as a whole.
    """
    g = df.groupBy(by, "p").agg(F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg"))
    g = carry(g, [by], "p", {"__below": ("sum", F.col("neg"))}, block=step)
    wins = F.col("pos") * (F.col("__below") + F.col("neg") / 2)
    x = g.withColumn("__w", wins).groupBy(by).agg(F.sum("__w").alias("w"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    return x.select(by, "n_pos", "n_neg", F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), F.col("w") / (F.col("n_pos") * F.col("n_neg"))).alias("auc"))


def sweep(long: DataFrame, configs: Sequence[str], lower_better: Sequence[str] = ()) -> DataFrame:
    """Metric by configuration, with the last against the first.

    ``long`` has ``(metric, config, value)``.
    """
    x = long.groupBy("metric").pivot("config", list(configs)).agg(F.max("value"))
    d = F.col(f"`{configs[-1]}`") - F.col(f"`{configs[0]}`")
    good = F.when(F.col("metric").isin(*lower_better), d < 0).otherwise(d > 0) if lower_better else d > 0
    return x.withColumn("delta", d).withColumn("verdict", F.when(d.isNull() | (d == 0), "").when(good, "better").otherwise("worse"))


def compare_variants(long: DataFrame, a: str, b: str) -> DataFrame:
    """Paired comparison: mean over the recordings having both variants."""
    x = long.groupBy("vid", "metric").agg(F.max(F.when(F.col("variant") == a, F.col("value"))).alias("a"), F.max(F.when(F.col("variant") == b, F.col("value"))).alias("b"))
    both = x.filter("a is not null and b is not null")
    return both.groupBy("metric").agg(F.count("*").alias("n"), F.avg("a").alias("mean_a"), F.avg("b").alias("mean_b"), F.avg(F.col("b") - F.col("a")).alias("mean_delta"))


def mix32(x: np.ndarray) -> np.ndarray:
    """Scrambled 32-bit numbers."""
    x = (x ^ (x >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    x = (x ^ (x >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return x ^ (x >> np.uint32(16))


def drawn(part: int, parts: int, n: int, reps: int, seed: int, size: int) -> np.ndarray:
    """Draws that fall on a part of ``size`` rows, per replicate: n rows are split in halves, and the draws with them.

    A half gets a binomial share, from a generator keyed by seed and half, so each
    part finds its own numbers alone, and those of all parts add up to n.
    """
    lo, hi, draws = 0, parts, np.full(reps, n, np.int64)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        left = (mid - lo) * size / (min(hi * size, n) - lo * size)
        key = np.array([seed & (2**64 - 1), lo << 32 | hi], np.uint64)
        share = np.random.Generator(np.random.Philox(key=key)).binomial(draws, left)
        lo, hi, draws = (lo, mid, share) if part < mid else (mid, hi, draws - share)
    return draws


def _draws(df: DataFrame, value: str, reps: int, seed: int, order: str, size: int) -> DataFrame:
    """Means of resamples with replacement, one row per replicate.

    Draw ``j`` of a replicate falls on the position that its hash names among all n rows, so
    the draws do not depend on ``size``.  They are hashed in chunks of ``DRAWS``; a chunk sends
    each part of ``size`` rows the places drawn there, packed into one binary (2 bytes a draw).
    A part meets its draws and yields one sum per replicate: it holds ``size`` rows and some
    ``size * reps`` draws, however many rows there are.
    """
    rows = cut(positions(df.select(order, F.col(value).cast("double").alias("v")), [order]).select("__i", "v"))
    n = rows.count()
    parts, per = -(-n // size), max(1, DRAWS // reps)
    place = np.uint16 if size <= 1 << 16 else np.uint32

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start = mix32(mix32(mix32(np.array([seed], np.uint64).astype(np.uint32)) + np.arange(reps, dtype=np.uint32)))
        for batch in batches:
            for chunk in batch.column(0).to_pylist():
                j = np.arange(chunk * per, min(n, (chunk + 1) * per), dtype=np.uint64).astype(np.uint32)
                hashes = mix32(start[:, None] + j * np.uint32(0x9E3779B9))
                at = (hashes.astype(np.uint64) * np.uint64(n) >> np.uint64(32)).ravel()
                part = (at // np.uint64(size)).astype(np.uint16 if parts <= 1 << 16 else np.uint32)
                by = np.argsort(part, kind="stable")  # by replicate within a part
                places = (at[by] - part[by].astype(np.uint64) * np.uint64(size)).astype(place)
                found, first = np.unique(part[by], return_index=True)
                ends = [*first[1:].tolist(), len(by)]
                spans = list(zip(first.tolist(), ends))
                times = [np.bincount(by[a:b] // len(j), minlength=reps).astype(np.uint32).tobytes() for a, b in spans]
                drawn_there = [places[a:b].tobytes() for a, b in spans]
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(times, pa.binary()), pa.array(drawn_there, pa.binary())], ["__part", "times", "places"])

    def part(table: pa.Table, draws: pa.Table) -> pa.Table:
        values = table.sort_by("__i")["v"].to_numpy()
        there = ~np.isnan(values)
        values, rep = np.where(there, values, 0.0), np.arange(reps, dtype=np.uint32)
        sums, counts = np.zeros(reps), np.zeros(reps, np.int64)
        for times, places in zip(draws["times"], draws["places"]):
            whose, at = np.repeat(rep, np.frombuffer(times.as_py(), np.uint32)), np.frombuffer(places.as_py(), place)
            sums += np.bincount(whose, values[at], reps)
            counts += np.bincount(whose[there[at]], minlength=reps)
        return pa.table({"rep": pa.array(rep, pa.int32()), "s": sums, "n": counts})

    dealt = df.sparkSession.range(-(-n // per)).mapInArrow(deal, "__part long, times binary, places binary")
    each = rows.withColumn("__part", F.floor(F.col("__i") / size)).groupBy("__part").cogroup(dealt.groupBy("__part")).applyInArrow(part, "rep int, s double, n long")
    return each.groupBy("rep").agg((F.sum("s") / F.sum("n")).alias(value))


def _bounds(means: DataFrame, v: str, reps: int, alpha: float) -> DataFrame:
    lo, hi = int(alpha / 2 * reps), int((1 - alpha / 2) * reps) - 1
    r = means.withColumn("__r", F.row_number().over(W.orderBy(v)) - 1)
    return r.agg(F.max(F.when(F.col("__r") == lo, F.col(v))).alias("ci_lo"), F.max(F.when(F.col("__r") == hi, F.col(v))).alias("ci_hi"))


def bootstrap_ci(df: DataFrame, value: str, reps: int = 2000, alpha: float = 0.05, seed: int = 42, order: str = "vid", size: int = PART) -> DataFrame:
    """Percentile interval of the mean; only the ``reps`` means are ordered.  Ids (``order``) may have any type."""
    return df.agg(F.avg(value).alias("mean")).crossJoin(_bounds(_draws(df, value, reps, seed, order, size), value, reps, alpha))  # one row each


def paired_ci(df: DataFrame, a: str, b: str, reps: int = 2000, alpha: float = 0.05, seed: int = 42, order: str = "vid", higher_better: bool = True, size: int = PART) -> DataFrame:
    """Interval of the mean paired difference, with a mark when it excludes zero."""
    x = bootstrap_ci(df.withColumn("__d", F.col(b) - F.col(a)).select(order, "__d"), "__d", reps, alpha, seed, order, size)
    up, down = F.col("ci_lo") > 0, F.col("ci_hi") < 0
    good, bad = (up, down) if higher_better else (down, up)
    return x.withColumn("mark", F.when(good, "better").when(bad, "worse").otherwise("~"))


def run_summary(stages: DataFrame, names: Sequence[str]) -> DataFrame:
    """Seconds per stage and recording, total, and the first failed stage.

    ``stages`` has ``(vid, stage, stage_no, seconds, ok)``.
    """
    fail = F.min_by(F.when(~F.col("ok"), F.col("stage")), F.when(~F.col("ok"), F.col("stage_no")))
    x = stages.groupBy("vid").agg(
        *[F.sum(F.when(F.col("stage") == s, F.col("seconds"))).alias(s) for s in names], F.sum("seconds").alias("total"), fail.alias("__f")
    )
    return x.withColumn("status", F.when(F.col("__f").isNull(), F.lit("OK")).otherwise(F.concat(F.lit("FAIL @ "), F.col("__f")))).drop("__f")


def variant_diff(a: DataFrame, b: DataFrame, gt: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Field deltas of differing segments and which variant is nearer the truth.

    ``a`` and ``b`` have ``(seg_id, *fields)``; ``gt`` has ``(seg_id, *fields)``.
    """
    pick = lambda df, s: df.select("seg_id", *[F.col(f).alias(f"{s}_{f}") for f in fields])
    x = pick(a, "a").join(pick(b, "b"), "seg_id").join(pick(gt, "g"), "seg_id", "left")
    rows = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"a_{f}").alias("a"), F.col(f"b_{f}").alias("b"), F.coalesce(f"g_{f}", F.lit(0)).alias("gt")) for f in fields])
    x = x.select("seg_id", F.explode(rows).alias("r")).select("seg_id", "r.*").filter("a <> b")
    da, db = F.abs(F.col("a") - F.col("gt")), F.abs(F.col("b") - F.col("gt"))
    verdict = F.when(da < db, "a_closer").when(db < da, "b_closer").otherwise("tied")
    return x.withColumn("delta", F.col("b") - F.col("a")).withColumn("verdict", verdict)


def verdict_tally(diff: DataFrame) -> DataFrame:
    return diff.groupBy("field", "verdict").agg(F.count("*").alias("n"))


def discrimination(df: DataFrame, label: str, flags: Sequence[str]) -> DataFrame:
    """Rate of each flag on positives and on the rest, and the difference."""
    pos = F.col(label) == 1
    rate = lambda f, c: F.avg(F.when(c, F.col(f).cast("int")))
    g = df.agg(*[x for f in flags for x in (rate(f, pos).alias(f"{f}_p"), rate(f, ~pos).alias(f"{f}_n"))])
    rows = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"{f}_p").alias("pos_rate"), F.col(f"{f}_n").alias("neg_rate")) for f in flags])
    return g.select(F.explode(rows).alias("r")).select("r.*", (F.col("r.pos_rate") - F.col("r.neg_rate")).alias("disc"))


def coverage_matrix(vids: DataFrame, **channels: DataFrame) -> DataFrame:
    """Which inputs exist for each recording."""
    x = vids.select("vid").distinct()
    for name, df in channels.items():
        x = x.join(df.select("vid").distinct().withColumn(name, F.lit(True)), "vid", "left").withColumn(name, F.coalesce(name, F.lit(False)))
    return x
