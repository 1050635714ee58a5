"""Report, detection, training and identity queries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from .. import views as V
from ..operators import detections as DT, identity as D, records as R, training as T
from ..plans import reports as P
from ..sources import sinks as K
from ..views import BLK, sql
from .matching import SQL_MAP, SQL_SHOT_COUNTS, SQL_TC, SQL_WC, counted, shot_eval, shot_segments, sql_match, tmap
from .records import sql_refine
from .registry import query
from .series import SQL_FUSE, SQL_LABELS, fused, labels, r6

SQL_PW = SQL_WC + ", pw AS (SELECT *, CAST(win_id % 4 AS int) AS pred_shots, CAST(CASE WHEN win_id % 9 = 0 THEN 1 ELSE 0 END AS int) AS pred_goals FROM wc)"


def windows(spark, sf):
    """Counted windows with predicted counts."""
    return counted(spark, sf).withColumn("pred_shots", F.expr("cast(win_id % 4 as int)")).withColumn("pred_goals", F.expr("if(win_id % 9 = 0, 1, 0)"))


def sql_err(d, s):
    return f"round_even(avg(abs({d})), 3) AS mae{s}, round_even(sqrt(avg(({d}) * ({d}))), 3) AS rmse{s}, round_even(avg({d}), 3) AS bias{s}, round_even(100 * avg(CASE WHEN {d} = 0 THEN 1 ELSE 0 END), 1) AS exact_pct{s}"


ERR = sql_err("pred_shots - gt_shots", "") + ", " + sql_err("pred_shots - gt_shots_unfiltered", "_unfiltered")
query("agg11_count_error", sql("games win gt", SQL_PW + f" SELECT count(*) AS n, {ERR} FROM pw"))(lambda s, d: P.count_error(windows(s, d)))
query("agg12_goal_confusion", sql("games win gt", SQL_PW + """,
c AS (SELECT vid, count(*) FILTER (gt_goals >= 1 AND pred_goals >= 1) AS tp, count(*) FILTER (gt_goals < 1 AND pred_goals >= 1) AS fp, count(*) FILTER (gt_goals >= 1 AND pred_goals < 1) AS fn, count(*) FILTER (gt_goals < 1 AND pred_goals < 1) AS tn FROM pw GROUP BY vid),
e AS (SELECT *, tp / nullif((tp + fp)::double, 0) AS pr, tp / nullif((tp + fn)::double, 0) AS rc FROM c)
SELECT vid, tp, fp, fn, tn, round_even(pr, 4) AS precision, round_even(rc, 4) AS recall, round_even(CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) END, 4) AS f1 FROM e"""))(
    lambda s, d: P.goal_confusion(windows(s, d), ["vid"])
)
TOT = ", ".join(f"CAST(sum({c}) AS bigint) AS {c}" for c in ("pred_shots", "gt_shots", "gt_shots_unfiltered", "pred_goals", "gt_goals", "gt_goals_unfiltered"))
MET = "pred_shots - gt_shots AS shots_diff, round_even(pred_shots / nullif(gt_shots::double, 0), 3) AS shots_ratio, pred_goals - gt_goals AS goals_diff, pred_shots - gt_shots_unfiltered AS shots_diff_unfiltered, round_even(pred_shots / nullif(gt_shots_unfiltered::double, 0), 3) AS shots_ratio_unfiltered"
query("agg13_metric_summary", sql("games win gt", SQL_PW + f", t AS (SELECT count(*) AS n_windows, {TOT} FROM pw) SELECT *, {MET} FROM t"))(lambda s, d: P.metric_summary(windows(s, d)))
query("agg13_shot_summary", sql("win gt games", SQL_SHOT_COUNTS + """,
t AS (SELECT count(*) AS n_videos, """ + ", ".join(f"CAST(sum({c}) AS bigint) AS {c}" for c in ("n_pred", "n_gt", "n_covered", "tp_strict", "tp_lenient", "fp", "fn", "fn_uncovered")) + """ FROM sc),
u AS (SELECT *, tp_strict / nullif((tp_strict + fp)::double, 0) AS p, tp_strict / nullif(n_gt::double, 0) AS r, tp_strict / nullif(n_covered::double, 0) AS rw FROM t)
SELECT * EXCLUDE (p, r, rw), round_even(p, 4) AS precision, round_even(r, 4) AS recall, round_even(rw, 4) AS recall_within_coverage, round_even(2 * p * r / (p + r), 4) AS f1, round_even(2 * p * rw / (p + rw), 4) AS f1_within_coverage FROM u"""))(
    lambda s, d: P.shot_summary(shot_eval(s, d))
)
def evaluated_counts(spark, sf):
    odd = V.games(spark, sf).selectExpr("vid", "vid % 2 = 0 as applied")
    shots = R.refine(shot_segments(spark, sf).withColumn("has_metrics", F.lit(True)), 1, 1, 3)
    return P.evaluate_counts(windows(spark, sf), shot_eval(spark, sf), P.event_totals(V.gt(spark, sf), tmap(spark, sf), odd), R.refine_summary(shots))


query("agg14_evaluate_counts", sql("games win gt", SQL_PW + "," + SQL_SHOT_COUNTS.replace(SQL_MAP + ",", "") + f""",
t AS (SELECT vid, count(*) AS n_windows, {TOT} FROM pw GROUP BY vid), e AS (SELECT vid, {ERR} FROM pw GROUP BY vid),
ot AS (SELECT g.vid, count(*) FILTER (g.action = 'Shots') AS game_shots, count(*) FILTER (g.action = 'Goals') AS game_goals FROM gt g
  LEFT JOIN games m ON m.vid = g.vid AND g.vid % 2 = 0 LEFT JOIN tm o ON o.vid = m.vid AND o.is_opponent AND NOT o.collision
  WHERE o.vid IS NULL OR {sql_match('g.team', 'o.team')} GROUP BY g.vid),
rs AS (SELECT win_id AS seg_id, vid, source <> 'faceoff' AS threat, start_s AS s, end_s AS e, true AS has_metrics, ['00:0' || win_id % 5, CASE WHEN win_id % 3 = 0 THEN '0:7' ELSE '00:75' END] AS tl FROM win),
{sql_refine(1, 1, 3)},
rm AS (SELECT vid, count(*) FILTER (refinement_source = 'shot_timestamps') AS n_refined, median(end_s - start_s) AS orig_width_median, median(end_refined - start_refined) AS refined_width_median FROM rf WHERE threat GROUP BY vid)
SELECT t.*, {MET}, e.* EXCLUDE (vid), tp_strict, tp_lenient, fp, fn, fn_uncovered, game_shots, game_goals, n_refined, orig_width_median, refined_width_median, orig_width_median - refined_width_median AS median_shrinkage
FROM t JOIN e USING (vid) LEFT JOIN sc USING (vid) LEFT JOIN ot USING (vid) LEFT JOIN rm USING (vid)"""))(evaluated_counts)

# -- per-second scores ------------------------------------------------------------
SQL_TICK = SQL_LABELS + "," + SQL_FUSE + ",\ntk AS (SELECT f.vid, f.t, f.p, l.label FROM fused f JOIN lab l USING (vid, t))"


def ticks(spark, sf):
    return fused(spark, sf).join(labels(spark, sf), ["vid", "t"])


SQL_TP = """count(*) FILTER (p > {t} AND label = 1) AS tp, count(*) FILTER (p > {t} AND label = 0) AS fp, count(*) FILTER (p <= {t} AND label = 1) AS fn"""
query("agg37_tick_prf", sql("ev gt probs", SQL_TICK + ", c AS (SELECT vid, " + SQL_TP.format(t=0.2) + """ FROM tk GROUP BY vid),
e AS (SELECT *, tp / greatest(1, tp + fp) AS p, tp / greatest(1, tp + fn) AS r FROM c) SELECT vid, tp, fp, fn, round(p, 6) AS p, round(r, 6) AS r, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1 FROM e"""))(
    lambda s, d: r6(P.tick_prf(ticks(s, d), 0.2), "p", "r", "f1")
)
query("agg35_auc", sql("ev gt probs", SQL_TICK + """,
r AS (SELECT vid, label, rank() OVER (PARTITION BY vid ORDER BY p) + (count(*) OVER (PARTITION BY vid, p) - 1) / 2.0 AS rk FROM tk),
a AS (SELECT vid, sum(label) AS n_pos, count(*) - sum(label) AS n_neg, sum(CASE WHEN label = 1 THEN rk ELSE 0 END) AS rs FROM r GROUP BY vid)
SELECT vid, CAST(n_pos AS bigint) AS n_pos, CAST(n_neg AS bigint) AS n_neg, round((rs - n_pos * (n_pos + 1) / 2) / (n_pos * n_neg), 6) AS auc FROM a"""))(
    lambda s, d: r6(P.auc(ticks(s, d)), "auc")
)


def sweep_rows(spark, sf):
    """Pooled per-second scores at three thresholds, in one pass."""
    x = ticks(spark, sf).withColumn("config", F.explode(F.array(F.lit("0.1"), F.lit("0.2"), F.lit("0.3"))))
    x = x.withColumn("p", F.when(F.col("p") > F.col("config").cast("double"), 1.0).otherwise(0.0))
    g = P.tick_prf(x, 0.5, ["config"])
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in ("tp", "fp", "fn", "p", "r", "f1")])
    return g.select("config", F.explode(rows).alias("m")).select("config", "m.metric", "m.value")


SQL_SW = SQL_TICK + "," + ",".join(f" s{i} AS (SELECT {SQL_TP.format(t=t)} FROM tk)" for i, t in enumerate((0.1, 0.2, 0.3))) + ",\n" + ",".join(
    f"v{i} AS (SELECT *, tp / greatest(1, tp + fp) AS p, tp / greatest(1, tp + fn) AS r, 2 * (tp / greatest(1, tp + fp)) * (tp / greatest(1, tp + fn)) / (tp / greatest(1, tp + fp) + tp / greatest(1, tp + fn)) AS f1 FROM s{i})" for i in range(3)
)
query("agg15_sweep", sql("ev gt probs", SQL_SW + ", m AS (" + " UNION ALL ".join(
    f"SELECT '{m}' AS metric, round(v0.{m}::double, 6) AS a, round(v1.{m}::double, 6) AS b, round(v2.{m}::double, 6) AS c FROM v0, v1, v2" for m in ("tp", "fp", "fn", "p", "r", "f1")
) + """) SELECT metric, a AS "0.1", b AS "0.2", c AS "0.3", round(c - a, 6) AS delta, CASE WHEN c = a THEN '' WHEN (metric IN ('fp','fn') AND c < a) OR (metric NOT IN ('fp','fn') AND c > a) THEN 'better' ELSE 'worse' END AS verdict FROM m"""))(
    lambda s, d: P.sweep(sweep_rows(s, d).withColumn("value", F.round("value", 6)), ["0.1", "0.2", "0.3"], ["fp", "fn"]).withColumn("delta", F.round("delta", 6))
)
SQL_VAR = """
va AS (SELECT o_custkey AS vid, o_orderstatus AS variant, avg(o_totalprice) / 1000 AS value FROM orders WHERE o_orderstatus IN ('F','O') GROUP BY 1, 2),
pv AS (SELECT vid, max(value) FILTER (variant = 'F') AS a, max(value) FILTER (variant = 'O') AS b FROM va GROUP BY vid), bo AS (SELECT * FROM pv WHERE a IS NOT NULL AND b IS NOT NULL)"""


def variants(spark, sf):
    o = V.table(spark, sf, "orders").filter("o_orderstatus in ('F', 'O')")
    return o.groupBy(F.col("o_custkey").alias("vid"), F.col("o_orderstatus").alias("variant")).agg((F.avg("o_totalprice") / 1000).alias("value")).withColumn("metric", F.lit("price"))


def paired(spark, sf):
    x = variants(spark, sf).groupBy("vid").agg(F.max(F.when(F.col("variant") == "F", F.col("value"))).alias("a"), F.max(F.when(F.col("variant") == "O", F.col("value"))).alias("b"))
    return x.filter("a is not null and b is not null")


query("agg16_compare_variants", sql("", SQL_VAR + " SELECT 'price' AS metric, count(*) AS n, round(avg(a), 6) AS mean_a, round(avg(b), 6) AS mean_b, round(avg(b - a), 6) AS mean_delta FROM bo"))(
    lambda s, d: r6(P.compare_variants(variants(s, d), "F", "O"), "mean_a", "mean_b", "mean_delta")
)


def mixed(x: str, p: str) -> str:
    """SQL columns that scramble a 32-bit number like ``mix32``; the last one is ``<p>5``."""
    return (
        f"xor({x}, {x} >> 16) AS {p}1, ({p}1 * 2246822507) & 4294967295 AS {p}2, xor({p}2, {p}2 >> 13) AS {p}3, "
        f"({p}3 * 3266489909) & 4294967295 AS {p}4, xor({p}4, {p}4 >> 16) AS {p}5"
    )


SQL_BOOT = SQL_VAR + """,
ix AS (SELECT row_number() OVER (ORDER BY vid) - 1 AS i, a, b - a AS dl, count(*) OVER () AS n FROM bo),
rp AS (SELECT rep, CAST((""" + str(int(P.mix32(np.array([42], np.uint32))[0])) + """ + rep) & 4294967295 AS ubigint) AS x, """ + mixed("x", "a") + "," + mixed("a5", "b") + """ FROM (SELECT unnest(range(200)) AS rep)),
dj AS (SELECT rep, n, CAST((b5 + j * 2654435769) & 4294967295 AS ubigint) AS y, """ + mixed("y", "c") + """ FROM rp, (SELECT i AS j, n FROM ix)),
dr AS (SELECT rep, CAST((c5 * n) >> 32 AS bigint) AS i FROM dj),
mn AS (SELECT rep, avg({c}) AS v FROM dr JOIN ix USING (i) GROUP BY rep), od AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS r FROM mn)"""
query("agg17_bootstrap_ci", sql("", SQL_BOOT.replace("{c}", "a") + " SELECT round((SELECT avg(a) FROM bo), 6) AS mean, round((SELECT v FROM od WHERE r = 5), 6) AS ci_lo, round((SELECT v FROM od WHERE r = 194), 6) AS ci_hi"))(
    lambda s, d: r6(P.bootstrap_ci(paired(s, d).select("vid", "a"), "a", 200), "mean", "ci_lo", "ci_hi")
)
query("agg18_paired_ci", sql("", SQL_BOOT.replace("{c}", "dl") + """, z AS (SELECT (SELECT avg(b - a) FROM bo) AS mean, (SELECT v FROM od WHERE r = 5) AS lo, (SELECT v FROM od WHERE r = 194) AS hi)
SELECT round(mean, 6) AS mean, round(lo, 6) AS ci_lo, round(hi, 6) AS ci_hi, CASE WHEN lo > 0 THEN 'better' WHEN hi < 0 THEN 'worse' ELSE '~' END AS mark FROM z"""))(
    lambda s, d: r6(P.paired_ci(paired(s, d), "a", "b", 200), "mean", "ci_lo", "ci_hi")
)
STAGES = ("detect", "metrics", "feedback")
query("agg31_run_summary", sql("ev", """
st AS (SELECT user_id AS vid, event_id % 3 AS k, value AS s, event_type <> 'error' OR event_id % 4 <> 0 AS ok FROM ev)
SELECT vid, round(sum(s) FILTER (k = 0), 4) AS detect, round(sum(s) FILTER (k = 1), 4) AS metrics, round(sum(s) FILTER (k = 2), 4) AS feedback, round(sum(s), 4) AS total,
  CASE WHEN bool_and(ok) THEN 'OK' ELSE 'FAIL @ ' || (['detect','metrics','feedback'])[min(k) FILTER (NOT ok) + 1] END AS status FROM st GROUP BY vid"""))(
    lambda s, d: P.run_summary(
        V.ev(s, d).selectExpr(
            "user_id as vid", "element_at(array('detect', 'metrics', 'feedback'), cast(event_id % 3 + 1 as int)) as stage", "event_id % 3 as stage_no",
            "value as seconds", "event_type <> 'error' or event_id % 4 <> 0 as ok",
        ), STAGES,
    ).withColumns({c: F.round(c, 4) for c in (*STAGES, "total")})
)


def diffed(spark, sf):
    w = windows(spark, sf)
    a = w.selectExpr("win_id as seg_id", "pred_shots as shots", "pred_goals as goals")
    b = w.selectExpr("win_id as seg_id", "cast(win_id % 3 as int) as shots", "if(win_id % 6 = 0, 1, 0) as goals")
    g = w.selectExpr("win_id as seg_id", "cast(gt_shots_unfiltered as int) as shots", "cast(gt_goals_unfiltered as int) as goals")
    return P.variant_diff(a, b, g, ["shots", "goals"])


SQL_DIFF = SQL_PW + """,
df AS (SELECT win_id AS seg_id, 'shots' AS field, pred_shots AS a, CAST(win_id % 3 AS int) AS b, CAST(gt_shots_unfiltered AS int) AS gt FROM pw
  UNION ALL SELECT win_id, 'goals', pred_goals, CASE WHEN win_id % 6 = 0 THEN 1 ELSE 0 END, CAST(gt_goals_unfiltered AS int) FROM pw),
dv AS (SELECT *, b - a AS delta, CASE WHEN abs(a - gt) < abs(b - gt) THEN 'a_closer' WHEN abs(b - gt) < abs(a - gt) THEN 'b_closer' ELSE 'tied' END AS verdict FROM df WHERE a <> b)"""
query("agg32_variant_diff", sql("games win gt", SQL_DIFF + " SELECT * FROM dv"))(diffed)
query("agg32_verdict_tally", sql("games win gt", SQL_DIFF + " SELECT field, verdict, count(*) AS n FROM dv GROUP BY 1, 2"))(lambda s, d: P.verdict_tally(diffed(s, d)))
query("agg34_discrimination", sql("", """
x AS (SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y, l_quantity > 25 AS travel, l_tax > 0.04 AS heard, l_discount > 0.05 AS held FROM lineitem),
r AS (SELECT 'travel' AS feature, avg(CASE WHEN y = 1 THEN travel::int END) AS p, avg(CASE WHEN y = 0 THEN travel::int END) AS n FROM x UNION ALL SELECT 'heard', avg(CASE WHEN y = 1 THEN heard::int END), avg(CASE WHEN y = 0 THEN heard::int END) FROM x
  UNION ALL SELECT 'held', avg(CASE WHEN y = 1 THEN held::int END), avg(CASE WHEN y = 0 THEN held::int END) FROM x)
SELECT feature, round(p, 6) AS pos_rate, round(n, 6) AS neg_rate, round(p - n, 6) AS disc FROM r"""))(
    lambda s, d: r6(
        P.discrimination(
            V.table(s, d, "lineitem").selectExpr("if(l_returnflag = 'R', 1, 0) as y", "l_quantity > 25 as travel", "l_tax > 0.04 as heard", "l_discount > 0.05 as held"), "y", ["travel", "heard", "held"]
        ), "pos_rate", "neg_rate", "disc",
    )
)
query("agg38_coverage_matrix", sql("games gt clips", "SELECT vid, vid IN (SELECT vid FROM gt) AS truth, vid IN (SELECT vid FROM clips) AS clips FROM games"))(
    lambda s, d: P.coverage_matrix(V.games(s, d), truth=V.gt(s, d), clips=V.clips(s, d))
)

# -- detections ----------------------------------------------------------------------
DIAG = 700.0
SQL_FEAT = """
fg AS (SELECT vid, t, count(*) FILTER (cls = 'puck') AS n_puck, coalesce(max(conf) FILTER (cls = 'puck'), 0) AS puck_conf_max, coalesce(avg(conf) FILTER (cls = 'puck'), 0) AS puck_conf_mean, count(*) FILTER (cls = 'goal') AS n_goal,
   coalesce(max(conf) FILTER (cls = 'goal'), 0) AS goal_conf_max, count(*) FILTER (cls = 'goalie') AS n_goalie, coalesce(max(conf) FILTER (cls = 'goalie'), 0) AS goalie_conf_max, count(*) FILTER (cls = 'player') AS n_player, count(*) FILTER (cls = 'centriod') AS n_centroid, count(*) FILTER (cls = 'faceoff') AS n_faceoff, count(*) FILTER (cls = 'referee') AS n_referee FROM det GROUP BY 1, 2),
pp AS (SELECT a.vid, a.t, a.cls AS ac, min(sqrt(pow((a.x1 + a.x2) / 2 - (b.x1 + b.x2) / 2, 2) + pow((a.y1 + a.y2) / 2 - (b.y1 + b.y2) / 2, 2))) / 700 AS dist, max(CASE WHEN a.x1 < b.x2 AND b.x1 < a.x2 AND a.y1 < b.y2 AND b.y1 < a.y2 THEN 1 ELSE 0 END) AS ins,
   max(CASE WHEN a.x1 < (b.x1 + b.x2) / 2 + (b.x2 - b.x1) AND (b.x1 + b.x2) / 2 - (b.x2 - b.x1) < a.x2 AND a.y1 < (b.y1 + b.y2) / 2 + (b.y2 - b.y1) AND (b.y1 + b.y2) / 2 - (b.y2 - b.y1) < a.y2 THEN 1 ELSE 0 END) AS ins2
  FROM det a JOIN det b ON a.vid = b.vid AND a.t = b.t AND b.cls = 'goal' AND a.cls IN ('puck','goalie') GROUP BY 1, 2, 3),
fr AS (SELECT DISTINCT CAST(o_custkey % 10 AS bigint) AS vid, CAST(o_orderkey AS int) AS t FROM orders UNION SELECT vid, t FROM det),
ft AS (SELECT fr.vid, fr.t, coalesce(n_puck, 0) AS n_puck, coalesce(puck_conf_max, 0.0) AS puck_conf_max, coalesce(puck_conf_mean, 0.0) AS puck_conf_mean, coalesce(n_goal, 0) AS n_goal, coalesce(goal_conf_max, 0.0) AS goal_conf_max, coalesce(n_goalie, 0) AS n_goalie,
  coalesce(goalie_conf_max, 0.0) AS goalie_conf_max, coalesce(n_player, 0) AS n_player, coalesce(n_centroid, 0) AS n_centroid, coalesce(n_faceoff, 0) AS n_faceoff, coalesce(n_referee, 0) AS n_referee, CASE WHEN fg.t IS NULL THEN 0.0 ELSE p.dist END AS puck_goal_min, CASE WHEN fg.t IS NULL THEN 0.0 ELSE k.dist END AS goalie_goal_min,
  coalesce(p.ins, 0) AS puck_in_goal, coalesce(p.ins2, 0) AS puck_in_goal_ext2 FROM fr LEFT JOIN fg USING (vid, t) LEFT JOIN pp p ON p.vid = fr.vid AND p.t = fr.t AND p.ac = 'puck' LEFT JOIN pp k ON k.vid = fr.vid AND k.t = fr.t AND k.ac = 'goalie')"""


def frames(spark, sf):
    o = V.table(spark, sf, "orders").selectExpr("o_custkey % 10 as vid", "cast(o_orderkey as int) as t")
    return o.unionByName(V.det(spark, sf).select("vid", "t")).distinct()


def features(spark, sf):
    return DT.detection_features(V.det(spark, sf), frames(spark, sf), DIAG)


FL = ("puck_conf_max", "puck_conf_mean", "goal_conf_max", "goalie_conf_max", "puck_goal_min", "goalie_goal_min")
query("agg24_detection_features", sql("det", SQL_FEAT + " SELECT * REPLACE (" + ", ".join(f"round({c}, 6) AS {c}" for c in FL) + ") FROM ft"))(lambda s, d: r6(features(s, d), *FL))
query("agg25_class_series", sql("det", """
SELECT vid, t, round(coalesce(max(conf) FILTER (cls = 'puck'), 0), 6) AS shot_max_conf, count(*) FILTER (cls = 'puck') AS shot_n, round(coalesce(max(conf) FILTER (cls = 'goal'), 0), 6) AS goal_max_conf FROM det GROUP BY 1, 2"""))(
    lambda s, d: r6(DT.class_series(V.det(s, d)), "shot_max_conf", "goal_max_conf")
)
query("agg36_detection_summary", sql("det", SQL_FEAT + """
SELECT vid, count(*) AS n_samples, count(*) FILTER (n_goal > 0) AS frames_with_goal, count(*) FILTER (n_goalie > 0) AS frames_with_goalie, count(*) FILTER (n_player > 0) AS frames_with_player,
  CAST(sum(n_goal) AS bigint) AS total_goal, CAST(sum(n_goalie) AS bigint) AS total_goalie, CAST(sum(n_player) AS bigint) AS total_player, round_even(100 * count(*) FILTER (n_goal > 0) / count(*), 0) AS pct_goal,
  round_even(100 * count(*) FILTER (n_goalie > 0) / count(*), 0) AS pct_goalie, round_even(100 * count(*) FILTER (n_player > 0) / count(*), 0) AS pct_player FROM ft GROUP BY vid"""))(
    lambda s, d: DT.detection_summary(V.det(s, d), frames(s, d))
)

# -- training data ---------------------------------------------------------------------
query("top3_hard_negatives", sql("det gt", SQL_FEAT + """,
nr AS (SELECT DISTINCT vid, unnest(range(start_s - 5, end_s + 6)) AS t FROM gt WHERE lower(action) = 'shots'),
c AS (SELECT vid, t, round(goal_conf_max * CASE WHEN n_player >= 5 THEN 1.0::double ELSE 0.5 END * CASE WHEN n_goalie >= 1 THEN 1.0::double ELSE 0.7 END, 9) AS score FROM ft f
  WHERE vid IN (SELECT vid FROM gt) AND n_goal >= 1 AND round(goal_conf_max, 6) >= 0.3 AND NOT EXISTS (SELECT 1 FROM nr WHERE nr.vid = f.vid AND nr.t = f.t))
SELECT * FROM c ORDER BY score DESC, CAST(vid AS varchar) DESC, t DESC LIMIT 500"""))(
    lambda s, d: T.hard_negatives(
        features(s, d).withColumn("goal_conf_max", F.round("goal_conf_max", 6)), V.gt(s, d), 500
    ).withColumn("score", F.round("score", 9))
)
query("top4_best_second", sql("probs gt", SQL_FUSE + """,
n AS (SELECT vid, max(t) + 1 AS dur FROM fused GROUP BY vid), g AS (SELECT DISTINCT vid, start_s, end_s, dur FROM gt JOIN n USING (vid) WHERE action = 'Shots'),
x AS (SELECT g.vid, g.start_s, g.end_s, f.t, f.p, row_number() OVER (PARTITION BY g.vid, g.start_s, g.end_s ORDER BY f.p DESC, f.t) AS r FROM g JOIN fused f ON f.vid = g.vid AND f.t BETWEEN greatest(g.start_s, 0) AND least(g.end_s, dur - 1))
SELECT vid, start_s, end_s, t, round(p, 6) AS conf FROM x WHERE r = 1 AND p >= 0.25"""))(
    lambda s, d: r6(T.best_second(V.gt(s, d), fused(s, d).withColumnRenamed("p", "conf"), 0.25, BLK), "conf")
)
SQL_SPLIT = """
c AS (SELECT o_custkey AS vid, count(*) AS n FROM orders GROUP BY 1), k AS (SELECT count(*) AS nn, least(greatest(3, round_even(count(*) * 0.25, 0)), count(*) - 1) AS want FROM c),
o AS (SELECT vid, n, row_number() OVER (ORDER BY n, vid) - 1 AS i FROM c), p AS (SELECT vid FROM o, k WHERE i % greatest(1, CAST(floor(nn / want) AS bigint)) = 0),
q AS (SELECT vid, row_number() OVER (ORDER BY vid) AS r FROM p), te AS (SELECT vid FROM q, k WHERE r <= want),
sp AS (SELECT c.vid, c.n, CASE WHEN te.vid IS NOT NULL THEN 'test' ELSE 'train' END AS split FROM c LEFT JOIN te USING (vid))"""


def splits(spark, sf):
    return T.stratified_split(V.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("vid")).agg(F.count("*").alias("n")))


query("top5_stratified_split", sql("", SQL_SPLIT + " SELECT * FROM sp"))(splits)
query("top7_train_subset", sql("", SQL_SPLIT + " SELECT vid, n FROM sp WHERE split = 'train' ORDER BY vid LIMIT 100"))(
    lambda s, d: T.train_subset(splits(s, d).filter("split = 'train'").select("vid", "n"), 100)
)
query("top8_hash_split", sql("", """
SELECT doc_id, CASE WHEN CAST(concat('0x', substr(md5('split-v1:' || doc_id), 1, 8)) AS bigint) / 4294967296.0::double < 0.2 THEN 'val' ELSE 'train' END AS split FROM documents"""))(
    lambda s, d: T.hash_split(V.table(s, d, "documents").select("doc_id", F.col("doc_id").cast("string").alias("k")), "k", 0.2).select("doc_id", "split")
)
query("top9_dataset", sql("det", SQL_SPLIT + """,
fr AS (SELECT DISTINCT o_custkey AS vid, CAST(o_orderkey AS int) AS t FROM orders), lb AS (SELECT CAST(l_suppkey AS bigint) AS vid, CAST(l_orderkey AS int) AS t, count(*) AS n_boxes FROM lineitem GROUP BY 1, 2)
SELECT fr.vid, fr.t, lb.n_boxes FROM fr JOIN lb USING (vid, t) WHERE fr.vid IN (SELECT vid FROM sp WHERE split = 'train')"""))(
    lambda s, d: T.dataset(
        V.table(s, d, "orders").selectExpr("o_custkey as vid", "cast(o_orderkey as int) as t").distinct(),
        V.table(s, d, "lineitem").groupBy(F.col("l_suppkey").alias("vid"), F.col("l_orderkey").cast("int").alias("t")).agg(F.count("*").alias("n_boxes")),
        splits(s, d).filter("split = 'train'"),
    )
)
BOX = "CASE l_linenumber % 5 WHEN 0 THEN 'shot' WHEN 1 THEN 'goal' WHEN 2 THEN 'goal' ELSE 'player' END"
query("top10_autolabel", sql("", f"""
b AS (SELECT l_orderkey AS vid, 0 AS t, l_linenumber * 10000000::bigint + l_partkey AS ln, {BOX} AS cls, l_discount * 10 AS cx, l_quantity / 50 AS cy, l_tax * 8 AS w, l_quantity / 90 AS h FROM lineitem),
g AS (SELECT vid, t, bool_or(cls = 'shot') AS has, arg_min({{'cx': cx, 'cy': cy, 'w': w, 'h': h}}, {{'l': ln, 'x': cx, 'y': cy, 'w': w}}) FILTER (cls = 'goal') AS g FROM b GROUP BY 1, 2),
s AS (SELECT *, CASE WHEN has THEN 'already_labelled' WHEN g IS NULL THEN 'no_goal' ELSE 'labelled' END AS status, least(1.0, g.w * 2.0) AS nw, least(1.0, g.h * 1.5) AS nh FROM g)
SELECT vid, t, status, CASE WHEN status = 'labelled' THEN round(greatest(nw / 2, least(1 - nw / 2, g.cx)), 6) END AS cx, CASE WHEN status = 'labelled' THEN round(greatest(nh / 2, least(1 - nh / 2, g.cy)), 6) END AS cy,
  CASE WHEN status = 'labelled' THEN round(nw, 6) END AS w, CASE WHEN status = 'labelled' THEN round(nh, 6) END AS h FROM s"""))(
    lambda s, d: r6(
        T.autolabel(
            V.table(s, d, "lineitem").selectExpr(
                "l_orderkey as vid", "0 as t", "struct(l_linenumber * 10000000L + l_partkey as l, l_discount * 10 as x, l_quantity / 50 as y, l_tax * 8 as w) as line_no", f"{BOX} as cls",
                "l_discount * 10 as cx", "l_quantity / 50 as cy", "l_tax * 8 as w", "l_quantity / 90 as h",
            )
        ), "cx", "cy", "w", "h",
    )
)
query("top11_sample_times", sql("ev", """
d AS (SELECT vid, max(t) AS duration FROM ev GROUP BY vid) SELECT vid, CAST(i AS int) AS i, round(30 + i * ((duration - 60) / 19.0::double), 6) AS t FROM d, (SELECT unnest(range(20)) AS i)"""))(
    lambda s, d: r6(T.sample_times(V.ev(s, d).groupBy("vid").agg(F.max("t").alias("duration")), 20), "t").select("vid", "i", "t")
)

# -- identities, resumable runs -----------------------------------------------------------
query("cln3_resolve_identity", sql("games gt win", SQL_TC + " SELECT action, expected_color, collision, count(*) AS n FROM (SELECT g.*, c.expected_color, c.collision FROM gt g LEFT JOIN tc c ON c.vid = g.vid AND c.ev_team = g.team) GROUP BY 1, 2, 3"))(
    lambda s, d: D.team_color(V.gt(s, d), tmap(s, d)).groupBy("action", "expected_color", "collision").agg(F.count("*").alias("n"))
)
query("snk8_pending", sql("", """
SELECT c_custkey AS vid FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')"""))(
    lambda s, d: K.pending(
        V.table(s, d, "customer").selectExpr("c_custkey as vid"),
        *[V.table(s, d, "orders").filter(f"o_orderstatus = '{x}'").selectExpr("o_custkey as vid") for x in ("F", "P")],
    )
)
query("snk9_upsert", sql("ev", """
u AS (SELECT user_id AS vid, arg_max(event_type, event_id) AS status FROM ev GROUP BY 1)
SELECT c_custkey AS vid, CASE WHEN u.vid IS NOT NULL THEN u.status ELSE c_mktsegment END AS status, c_name FROM customer LEFT JOIN u ON u.vid = c_custkey"""))(
    lambda s, d: K.upsert(
        V.table(s, d, "customer").selectExpr("c_custkey as vid", "c_mktsegment as status", "c_name"),
        V.ev(s, d).groupBy(F.col("user_id").alias("vid")).agg(F.max_by("event_type", "event_id").alias("status")), "vid",
    )
)
SQL_PURGE = """
rf AS (SELECT event_id AS ref_id, user_id AS list_id, CASE WHEN event_id % 4 = 0 THEN 'v_' || user_id ELSE 'v_' || user_id || '_' || t || '_' || (t + 9) END AS clip_id, event_type AS kind FROM ev),
pv AS (SELECT 'v_' || user_id AS vid FROM ev WHERE event_type = 'signup' GROUP BY user_id HAVING max(value) > 60),
rm AS (SELECT * FROM rf WHERE EXISTS (SELECT 1 FROM pv WHERE rf.clip_id = pv.vid OR starts_with(rf.clip_id, pv.vid || '_')))"""


def refs(spark, sf):
    r = V.ev(spark, sf).selectExpr(
        "event_id as ref_id", "user_id as list_id", "if(event_id % 4 = 0, concat('v_', user_id), concat('v_', user_id, '_', t, '_', t + 9)) as clip_id", "event_type as kind"
    )
    p = V.ev(spark, sf).filter("event_type = 'signup'").groupBy("user_id").agg(F.max("value").alias("m")).filter("m > 60").select(F.concat(F.lit("v_"), F.col("user_id")).alias("vid"))
    return r, p


query("snk10_purge_refs", sql("ev", SQL_PURGE + " SELECT ref_id, clip_id FROM rf WHERE ref_id NOT IN (SELECT ref_id FROM rm)"))(
    lambda s, d: K.purge_refs(*refs(s, d), "clip_id", "ref_id")[0].select("ref_id", "clip_id")
)
query("snk10_purge_counts", sql("ev", SQL_PURGE + " SELECT kind, count(*) AS removed FROM rm GROUP BY kind"))(
    lambda s, d: K.purge_refs(*refs(s, d), "clip_id", "ref_id")[1].groupBy("kind").agg(F.count("*").alias("removed"))
)
query("snk10_shrink_lists", sql("ev", SQL_PURGE + """
SELECT l.list_id, count(*) FILTER (ref_id NOT IN (SELECT ref_id FROM rm)) AS n_items, count(*) FILTER (ref_id NOT IN (SELECT ref_id FROM rm)) = 0 AS revoked FROM rf l GROUP BY 1"""))(
    lambda s, d: K.shrink_lists(refs(s, d)[0].select("list_id").distinct(), refs(s, d)[0], K.purge_refs(*refs(s, d), "clip_id", "ref_id")[0], "list_id")
)
