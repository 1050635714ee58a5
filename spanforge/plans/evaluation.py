"""Evaluation jobs: predictions against ground truth, for all recordings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..blocks import BLOCK, cut
from ..functions.selection import selected
from ..functions.spans import iou, midpoint
from ..functions.stats import f1, prf, ratio
from ..functions.text import colors_match
from ..operators import identity, intervals as I, matching as M


def counts(gt_rows: DataFrame, gt: DataFrame, pred: DataFrame, matches: DataFrame) -> DataFrame:
    """Counts of every recording with ground-truth rows, whatever their action.

    A recording whose truth holds no threat keeps its predictions as false positives.
    """
    v = gt_rows.select("vid").distinct()
    g = gt.groupBy("vid").agg(F.count("*").alias("n_gt"))
    p = pred.groupBy("vid").agg(F.count("*").alias("n_pred"))
    m = matches.groupBy("vid").agg(F.count("*").alias("tp"))
    x = v.join(g, "vid", "left").join(p, "vid", "left").join(m, "vid", "left").na.fill(0, ["n_gt", "n_pred", "tp"])
    return x.withColumn("fp", F.col("n_pred") - F.col("tp")).withColumn("fn", F.col("n_gt") - F.col("tp"))


def pooled(per_vid: DataFrame) -> DataFrame:
    """Per-recording rows plus one pooled row (``vid`` null): sums, then ratios."""
    sums = [F.sum(c).alias(c) for c in ("tp", "fp", "fn", "n_gt", "n_pred")]
    x = per_vid.rollup("vid").agg(*sums)
    return x.select("vid", "tp", "fp", "fn", "n_gt", "n_pred", *prf(F.col("tp"), F.col("fp"), F.col("fn")))


def eval_strict(
    gt_rows: DataFrame, pred: DataFrame, thr: float = 0.30, pad: float = 2.0, gap: float = 8, block: int = BLOCK
) -> DataFrame:
    """Window evaluation: merge truth, pad, match by IoU, pooled P/R/F1."""
    gt = cut(I.pad(I.merge_events(gt_rows, gap), pad))
    return pooled(counts(gt_rows, gt, pred, M.match_iou(gt, pred, thr, block)))


def eval_spotting(gt_rows: DataFrame, pred: DataFrame, tol: float = 5.0, gap: float = 8, block: int = BLOCK) -> DataFrame:
    """Event spotting: match midpoints within ``tol`` seconds."""
    mid = midpoint(F.col("start_s"), F.col("end_s")).alias("t")
    gt = cut(I.merge_events(gt_rows, gap).select("vid", "gt_id", mid))
    p = pred.select("vid", "pred_id", mid)
    return pooled(counts(gt_rows, gt, p, M.match_tolerance(gt, p, tol, block)))


def recall_at(cand: DataFrame, gt: DataFrame, tols=(5.0, 10.0)) -> DataFrame:
    """Share of truth midpoints with a candidate within each tolerance."""
    mids = gt.withColumn("__mid", midpoint(F.col("start_s"), F.col("end_s")))
    aggs = [F.count("*").alias("n_gt")]
    flagged = mids
    for t in tols:
        band = cand.select("vid", (F.col("t_seconds") - t).alias("start_s"), (F.col("t_seconds") + t).alias("end_s"))
        flagged = M.covered(flagged, band, "__mid", f"hit_{t:g}")
        aggs.append(F.count_if(f"hit_{t:g}").alias(f"hits_{t:g}s"))
    x = flagged.groupBy("vid").agg(*aggs)
    return x.select("vid", "n_gt", *[f"hits_{t:g}s" for t in tols], *[ratio(F.col(f"hits_{t:g}s"), F.col("n_gt"), None).alias(f"recall_{t:g}s") for t in tols])


def recall_total(per_vid: DataFrame, tols=(5.0, 10.0)) -> DataFrame:
    """Recall over all recordings, weighted by the number of truth events."""
    n = F.sum("n_gt")
    return per_vid.agg(n.alias("n_gt"), *[ratio(F.sum(f"hits_{t:g}s"), F.greatest(n, F.lit(1)), None).alias(f"recall_{t:g}s") for t in tols])


def candidate_report(cand: DataFrame, gt: DataFrame, lengths: DataFrame, block: int = BLOCK) -> DataFrame:
    """Per-game summary: counts, recall, false positives, candidates a minute.

    ``lengths`` has ``(vid, duration)``; ``cand`` is the ranked list.
    """
    noted = M.annotate(cand, gt, 5.0, block)
    c = noted.groupBy("vid").agg(
        F.count("*").alias("n_candidates"), F.count_if(F.col("gt_match_t_seconds").isNull()).alias("n_fp_at_5s")
    )
    r = recall_at(cand, gt)
    x = c.join(r, "vid", "left").join(lengths, "vid", "left")
    x = x.na.fill(0, ["n_gt", "recall_5s", "recall_10s", "duration"])
    per_min = F.col("n_candidates") / F.greatest(F.lit(1.0), F.col("duration") / 60)
    return x.select("vid", "n_candidates", "n_gt", "recall_5s", "recall_10s", "n_fp_at_5s", "duration", per_min.alias("cand_per_min"))


def top_false_positives(annotated: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` most confident unmatched candidates over all recordings."""
    fp = annotated.filter(F.col("gt_match_t_seconds").isNull()).select("confidence", "vid", "t_mmss")
    return fp.orderBy(F.desc("confidence"), F.desc(F.col("vid").cast("string")), F.desc("t_mmss")).limit(k)


def sample_top(cand: DataFrame, k: int = 10) -> DataFrame:
    return cand.filter(F.col("rank") <= k)


# -- full window evaluation ---------------------------------------------------


def evaluate(
    gt: DataFrame, pred: DataFrame, games: DataFrame, meta: DataFrame, thr: float = 0.30, pad: float = 2.0, block: int = BLOCK
) -> DataFrame:
    """Matched, missed and spurious windows with the attribution verdict.

    ``gt`` comes from ``merge_events``; ``pred`` has ``(vid, pred_id, start_s,
    end_s, color)``.  ``kind`` is ``match``, ``fn`` or ``fp``.
    """
    gt = cut(identity.restrict_gt(gt, games, meta))
    matches = M.match_iou(I.pad(gt, pad), pred, thr, block)
    g = gt.select("vid", "gt_id", F.col("start_s").alias("gt_start"), F.col("end_s").alias("gt_end"), F.col("team").alias("gt_team"))
    p = pred.select("vid", "pred_id", F.col("start_s").alias("pred_start"), F.col("end_s").alias("pred_end"), F.col("color").alias("pred_color"))
    # one pass: every truth row, every prediction row, matched where possible
    x = g.join(matches, ["vid", "gt_id"], "left")
    x = x.withColumn("__k", F.coalesce(F.col("pred_id").cast("string"), F.concat(F.lit("g"), F.col("gt_id").cast("string"))))
    p = p.withColumn("__k", F.col("pred_id").cast("string")).drop("pred_id")
    x = x.join(p, ["vid", "__k"], "full_outer")
    x = identity.team_color(x, identity.team_map(games), "gt_team")
    known = ~F.coalesce("collision", F.lit(True)) & F.col("expected_color").isNotNull()
    verdict = (
        F.when(F.col("gt_start").isNull(), F.lit("n/a (FP)"))
        .when(F.col("pred_start").isNull(), F.lit("n/a (FN)"))
        .when(~known, F.lit("skipped"))
        .when(F.col("pred_color").isNull(), F.lit("missing_color"))
        .when(colors_match(F.col("pred_color"), F.col("expected_color")), F.lit("correct"))
        .otherwise(F.concat(F.lit("wrong (expected "), F.col("expected_color"), F.lit(")")))
    )
    raw = iou(F.col("gt_start"), F.col("gt_end"), F.col("pred_start"), F.col("pred_end"))
    kind = F.when(F.col("gt_start").isNull(), "fp").when(F.col("pred_start").isNull(), "fn").otherwise("match")
    return x.select(
        "vid", kind.alias("kind"), "gt_start", "gt_end", "gt_team", "pred_start", "pred_end", "pred_color",
        F.bround(F.coalesce("score", F.lit(0.0)), 3).alias("iou"),
        F.bround(F.when(F.col("score").isNotNull(), raw), 3).alias("iou_raw"),
        verdict.alias("attribution"),
    )


def aggregate_eval(rows: DataFrame, hits: DataFrame | None = None) -> DataFrame:
    """Pooled and per-recording scores from ``evaluate`` rows (``vid`` null = all)."""
    a = F.col("attribution")
    x = rows.groupBy("vid").agg(
        F.count_if(F.col("kind") == "match").alias("tp"),
        F.count_if(F.col("kind") == "fp").alias("fp"),
        F.count_if(F.col("kind") == "fn").alias("fn"),
        F.count_if(a == "correct").alias("attr_correct"),
        F.count_if(a.startswith("wrong")).alias("attr_wrong"),
        F.count_if(a.isin("skipped", "missing_color")).alias("attr_skipped"),
    )
    cols = ["tp", "fp", "fn", "attr_correct", "attr_wrong", "attr_skipped"]
    if hits is not None:
        x = x.join(hits, "vid", "left").na.fill(0)
        cols += ["gt_hits", "gt_total", "pred_hits", "pred_total"]
    x = x.rollup("vid").agg(*[F.sum(c).alias(c) for c in cols], F.count("*").alias("videos"))
    out = x.select(
        "*", *prf(F.col("tp"), F.col("fp"), F.col("fn")),
        ratio(F.col("attr_correct"), F.col("attr_correct") + F.col("attr_wrong"), 4, None).alias("attribution_accuracy"),
    )
    if hits is None:
        return out
    mr, mp = ratio(F.col("gt_hits"), F.col("gt_total"), None, None), ratio(F.col("pred_hits"), F.col("pred_total"), None, None)
    return out.select(
        "*", F.bround(mr, 4).alias("midpoint_recall"), F.bround(mp, 4).alias("midpoint_precision"),
        F.bround(F.when(mr + mp > 0, f1(mp, mr)), 4).alias("midpoint_f1"),
    )


def diagnose(rows: DataFrame, gt: DataFrame, pred: DataFrame, near_s: float = 30.0, near_iou: float = 0.05) -> DataFrame:
    """Classify every miss and false alarm by its nearest unmatched counterpart.

    Matches are identified by bounds, so a duplicate of a matched window counts
    as matched.
    """
    rows = cut(rows)
    m = rows.filter("kind = 'match'")
    mg = m.select("vid", F.col("gt_start").alias("start_s"), F.col("gt_end").alias("end_s")).distinct()
    mp = m.select("vid", F.col("pred_start").alias("start_s"), F.col("pred_end").alias("end_s")).distinct()
    bounds = ["vid", "start_s", "end_s"]
    free_gt, free_pred = cut(gt.join(mg, bounds, "left_anti")), cut(pred.join(mp, bounds, "left_anti"))

    def classify(side: DataFrame, pool: DataFrame, idx: str, kind: str, names: list[str]) -> DataFrame:
        x = M.nearest(side, pool, idx)
        cls = (
            F.when(F.col("near").isNull(), names[0])
            .when(F.col("near.dist") > near_s, names[1])
            .when(F.col("near.iou") >= near_iou, F.lit("scale_mismatch"))
            .otherwise(names[2])
        )
        return x.select(
            "vid", F.lit(kind).alias("kind"), "start_s", "end_s", F.col("near.start_s").alias("near_start"),
            F.col("near.end_s").alias("near_end"), F.bround("near.dist", 1).alias("delta"),
            F.bround("near.iou", 3).alias("iou"), cls.alias("class"),
        )

    fn = classify(free_gt.select("vid", "gt_id", "start_s", "end_s"), free_pred, "pred_id", "FN", ["no_pred", "missed_entirely", "no_spatial_overlap"])
    fp = classify(free_pred.select("vid", "pred_id", "start_s", "end_s"), free_gt, "gt_id", "FP", ["no_gt", "spurious", "adjacent_to_gt"])
    return fn.unionByName(fp)


def diagnose_summary(rows: DataFrame) -> DataFrame:
    return rows.groupBy("kind", "class").agg(F.count("*").alias("n"))


def index_quantiles(df: DataFrame, col: str, by: str | None = None) -> DataFrame:
    """Order statistics by position ``n div 4, n div 2, 3n div 4``, of the whole table or per group of ``by``."""
    keys = [by] if by else []
    x = cut(df.filter(F.col(col).isNotNull()).select(*keys, F.col(col).alias("__v")))
    n = F.count("*")
    plain = x.groupBy(*keys).agg(n.alias("n"), F.min("__v").alias("min"), F.max("__v").alias("max"), F.avg("__v").alias("mean"))
    at = selected(x, "__v", keys, {"p25": F.floor(n / 4), "median": F.floor(n / 2), "p75": F.floor(n * 3 / 4)})
    both = plain.join(at, keys) if keys else plain.crossJoin(F.broadcast(at))  # one row each
    return both.select(*keys, "n", "min", "p25", "median", "p75", "max", "mean")


def fp_trace(rows: DataFrame, trace: DataFrame, block: int = BLOCK) -> DataFrame:
    """False positives with the combination of sources behind each."""
    rows = cut(rows)
    m = rows.filter("kind = 'match'").select("vid", "pred_start", "pred_end").distinct()
    fp = rows.filter("kind = 'fp'").join(m, ["vid", "pred_start", "pred_end"], "left_anti")
    fp = fp.select("vid", F.col("pred_start").alias("start_s"), F.col("pred_end").alias("end_s"), F.col("pred_color").alias("color"))
    x = M.trace_lookup(fp, trace, block=block)
    combo = F.when(F.size("source_signals") > 0, F.array_join("source_signals", "+")).otherwise(F.lit("(no_trace)"))
    return x.withColumn("combo", combo)


def fp_by_combo(traced: DataFrame) -> DataFrame:
    return traced.groupBy("combo").agg(F.count("*").alias("n"))


def fp_by_signal(traced: DataFrame) -> DataFrame:
    return traced.select(F.explode("source_signals").alias("signal")).groupBy("signal").agg(F.count("*").alias("n"))


def fp_top_combos(traced: DataFrame, k: int = 3) -> DataFrame:
    """The ``k`` most frequent combinations per recording."""
    c = traced.groupBy("vid", "combo").agg(F.count("*").alias("n"), F.min("start_s").alias("__first"))
    w = W.partitionBy("vid").orderBy(F.desc("n"), F.asc("__first"))
    return c.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).drop("__first")


def offset_stats(pairs: DataFrame) -> DataFrame:
    """Distribution of the time offset of matched pairs."""
    return index_quantiles(pairs, "score")
