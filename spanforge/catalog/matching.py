"""Matching and window-evaluation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import views as V
from ..blocks import cut
from ..functions.spans import midpoint
from ..operators import identity as D, intervals as I, matching as M, series as S
from ..plans import evaluation as E
from ..views import BLK, sql
from .intervals import SQL_GT, SQL_TRACE, SQL_WINDOWS, gtm, pred, traced
from .registry import query
from .series import SQL_CAND, cands, fused, r6

# predictions carry a colour: unknown now and then
SQL_P = SQL_WINDOWS + "," + SQL_GT + """,
pr AS (SELECT vid, CAST(start_s AS int) AS pred_id, start_s, end_s,
       CASE WHEN start_s % 7 = 0 THEN NULL WHEN start_s % 2 = 0 THEN 'White' ELSE 'Navy Blue' END AS color FROM pred)"""


def preds(spark, sf):
    """Predicted windows, written once: every evaluation reads them repeatedly."""
    return cut(pred(spark, sf).selectExpr(
        "vid", "start_s as pred_id", "start_s", "end_s",
        "case when start_s % 7 = 0 then null when start_s % 2 = 0 then 'White' else 'Navy Blue' end as color",
    ))


SQL_GREEDY = """,
rk AS (SELECT *, row_number() OVER (PARTITION BY vid ORDER BY {order}) AS rn FROM cp),
gw AS (
  SELECT DISTINCT vid, CAST(0 AS bigint) AS rn, CAST([] AS int[]) AS ug, CAST([] AS int[]) AS up,
         CAST(NULL AS int) AS gt_id, CAST(NULL AS int) AS pred_id, CAST(NULL AS double) AS score FROM rk
  UNION ALL
  SELECT w.vid, r.rn,
    CASE WHEN list_contains(w.ug, r.gt_id) OR list_contains(w.up, r.pred_id) THEN w.ug ELSE list_append(w.ug, r.gt_id) END,
    CASE WHEN list_contains(w.ug, r.gt_id) OR list_contains(w.up, r.pred_id) THEN w.up ELSE list_append(w.up, r.pred_id) END,
    CASE WHEN list_contains(w.ug, r.gt_id) OR list_contains(w.up, r.pred_id) THEN NULL ELSE r.gt_id END,
    r.pred_id, r.score
  FROM gw w JOIN rk r ON r.vid = w.vid AND r.rn = w.rn + 1),
mt AS (SELECT vid, gt_id, pred_id, score FROM gw WHERE gt_id IS NOT NULL)"""
SQL_IOU = """
cp AS (SELECT * FROM (SELECT g.vid, g.gt_id, p.pred_id,
    greatest(least(ge, p.end_s) - greatest(gs, p.start_s), 0) / CAST((ge - gs) + (p.end_s - p.start_s) - greatest(least(ge, p.end_s) - greatest(gs, p.start_s), 0) AS double) AS score
  FROM (SELECT vid, gt_id, greatest(start_s - {pad}, 0) AS gs, end_s + {pad} AS ge FROM {gt}) g
  JOIN pr p ON p.vid = g.vid AND p.start_s <= ge AND gs <= p.end_s) WHERE score >= {thr})""" + SQL_GREEDY.format(
    order="score DESC, gt_id DESC, pred_id DESC"
)
SQL_M = SQL_P + "," + SQL_IOU.replace("{pad}", "2").replace("{gt}", "gtm").replace("{thr}", "0.2")
THR = 0.2


def padded(spark, sf):
    return I.pad(gtm(spark, sf), 2)


query("jon6_match_iou", sql("probs gt", SQL_M + " SELECT vid, gt_id, pred_id, round(score, 6) AS score FROM mt"))(
    lambda s, d: r6(M.match_iou(padded(s, d), preds(s, d), THR, BLK), "score")
)

SQL_MID = SQL_P + """,
cp AS (SELECT g.vid, g.gt_id, p.pred_id, abs(0.5::double * (g.start_s + g.end_s) - 0.5::double * (p.start_s + p.end_s)) AS score
       FROM gtm g JOIN pr p ON p.vid = g.vid AND abs(0.5::double * (g.start_s + g.end_s) - 0.5::double * (p.start_s + p.end_s)) <= 5)""" + SQL_GREEDY.format(
    order="score, gt_id, pred_id"
)


def mids(df, idx):
    return df.select("vid", idx, midpoint(F.col("start_s"), F.col("end_s")).alias("t"))


def tol_matches(spark, sf):
    return M.match_tolerance(mids(gtm(spark, sf), "gt_id"), mids(preds(spark, sf), "pred_id"), 5.0, BLK)


query("jon7_match_tolerance", sql("probs gt", SQL_MID + " SELECT vid, gt_id, pred_id, score FROM mt"))(tol_matches)

SQL_HITS = """
hg AS (SELECT g.vid, count(*) AS gt_total, count(*) FILTER (EXISTS (SELECT 1 FROM pr p WHERE p.vid = g.vid AND 0.5::double * (g.start_s + g.end_s) BETWEEN p.start_s AND p.end_s)) AS gt_hits FROM {gt} g GROUP BY 1),
hp AS (SELECT p.vid, count(*) AS pred_total, count(*) FILTER (EXISTS (SELECT 1 FROM {gt} g WHERE p.vid = g.vid AND 0.5::double * (p.start_s + p.end_s) BETWEEN g.start_s AND g.end_s)) AS pred_hits FROM pr p GROUP BY 1),
hits AS (SELECT vid, coalesce(gt_hits, 0) AS gt_hits, coalesce(gt_total, 0) AS gt_total, coalesce(pred_hits, 0) AS pred_hits, coalesce(pred_total, 0) AS pred_total
         FROM hg FULL JOIN hp USING (vid))"""
query("jon10_midpoint_hits", sql("probs gt", SQL_P + "," + SQL_HITS.format(gt="gtm") + " SELECT * FROM hits"))(
    lambda s, d: M.midpoint_hits(gtm(s, d), preds(s, d))
)
SQL_ANN = SQL_CAND + "," + SQL_GT + """,
an AS (SELECT c.*, x.mid, x.d, x.team FROM cand c LEFT JOIN (
  SELECT vid, t_seconds, r.mid AS mid, r.d AS d, r.team AS team FROM (SELECT c.vid, c.t_seconds,
    arg_min({'mid': m.mid, 'd': abs(c.t_seconds - m.mid), 'team': m.team}, abs(c.t_seconds - m.mid) * 100000 + m.gt_id) AS r
  FROM cand c JOIN (SELECT vid, gt_id, team, 0.5::double * (start_s + end_s) AS mid FROM gtm) m ON m.vid = c.vid AND abs(c.t_seconds - m.mid) <= 5 GROUP BY 1, 2)) x USING (vid, t_seconds)),
ann AS (SELECT vid, rank, t_seconds, t_mmss, confidence, CAST(floor(mid) AS int) AS gt_match_t_seconds,
  coalesce(lpad(CAST(floor(mid) AS int) // 60 || '', 2, '0') || ':' || lpad(CAST(floor(mid) AS int) % 60 || '', 2, '0'), '—') AS gt_match_t_mmss, d AS gt_match_delta_s, coalesce(team, '—') AS gt_team FROM an)"""


def annotated(spark, sf):
    return M.annotate(cands(spark, sf), gtm(spark, sf), 5.0, BLK)


query("jon5_annotate", sql("probs gt", SQL_ANN + " SELECT * FROM ann"))(annotated)
SQL_NEAR = """
SELECT g.vid, g.gt_id, arg_min(p.pred_id, abs(0.5::double * (g.start_s + g.end_s) - 0.5::double * (p.start_s + p.end_s)) * 1000000 + p.pred_id) AS near_id,
  min(abs(0.5::double * (g.start_s + g.end_s) - 0.5::double * (p.start_s + p.end_s))) AS dist
FROM gtm g JOIN pr p ON p.vid = g.vid GROUP BY 1, 2"""
query("jon12_nearest", sql("probs gt", SQL_P + SQL_NEAR))(
    lambda s, d: M.nearest(gtm(s, d), preds(s, d), "pred_id").filter("near is not null").select("vid", "gt_id", F.col("near.idx").alias("near_id"), F.col("near.dist").alias("dist"))
)
SQL_TL = SQL_TRACE + """,
te AS (SELECT vid, start_s + ((start_s % 3) - 1) * 0.3::double AS ts, end_s + 0.2::double * (end_s % 4) AS te, start_s AS ord, source_signals, n_overlapping_raw AS n_raw FROM tr),
tl AS (SELECT p.vid, p.start_s, p.end_s, arg_min(t.source_signals, t.ord) AS src, coalesce(arg_min(t.n_raw, t.ord), 0) AS n_raw FROM pred p
  LEFT JOIN te t ON t.vid = p.vid AND abs(t.ts - p.start_s) < 0.5 AND abs(t.te - p.end_s) < 0.5 GROUP BY 1, 2, 3)"""


def trace_table(spark, sf):
    """Trace entries with slightly shifted bounds."""
    return traced(spark, sf).selectExpr(
        "vid", "start_s as ord", "start_s + ((start_s % 3) - 1) * 0.3D as start_s", "end_s + 0.2D * (end_s % 4) as end_s",
        "source_signals", "n_overlapping_raw as n_raw",
    )


query("jon14_trace_lookup", sql("probs win", SQL_TL + " SELECT vid, start_s, end_s, coalesce(array_to_string(src, '+'), '') AS combo, n_raw FROM tl"))(
    lambda s, d: M.trace_lookup(pred(s, d), trace_table(s, d), block=BLK).select(
        "vid", "start_s", "end_s", F.array_join("source_signals", "+").alias("combo"), "n_raw"
    )
)

# -- team identity -------------------------------------------------------------
SQL_COLORS = "['white','black','red','blue','green','yellow','orange','purple','pink','gold','silver','grey','gray','navy','maroon','teal','tan']"


def sql_tok(c):
    return f"list_filter({SQL_COLORS}, lambda w: contains(lower({c}), w))"


SQL_MAP = f"""
tm AS (SELECT vid, 0 AS pos, target_team AS team, opponent_color AS threatened_color, false AS is_opponent,
         len(list_intersect({sql_tok('target_color')}, {sql_tok('opponent_color')})) > 0 AS collision,
         CAST(len({sql_tok('target_color')}) = 0 AS int) + CAST(len({sql_tok('opponent_color')}) = 0 AS int) AS warnings FROM games
       UNION ALL
       SELECT vid, 1, opponent_team, target_color, true, len(list_intersect({sql_tok('target_color')}, {sql_tok('opponent_color')})) > 0,
         CAST(len({sql_tok('target_color')}) = 0 AS int) + CAST(len({sql_tok('opponent_color')}) = 0 AS int) FROM games)"""


def tmap(spark, sf):
    return D.team_map(V.games(spark, sf))


query("jon17_team_map", sql("games", SQL_MAP + " SELECT * FROM tm"))(tmap)
SQL_TT = SQL_MAP + f""",
tt AS (SELECT w.vid, w.win_id, w.start_s, w.end_s, w.color, CASE WHEN count(t.team) = 1 THEN min(t.team) END AS target_team
  FROM win w LEFT JOIN tm t ON t.vid = w.vid AND len(list_intersect({sql_tok('t.threatened_color')}, {sql_tok('w.color')})) > 0 GROUP BY ALL)"""


def win_teams(spark, sf):
    return D.target_team(V.win(spark, sf), tmap(spark, sf))


query("jon15_target_team", sql("games win", SQL_TT + " SELECT vid, win_id, target_team FROM tt"))(
    lambda s, d: win_teams(s, d).select("vid", "win_id", "target_team")
)


def sql_words(c):
    return f"list_distinct(list_filter(regexp_split_to_array(lower(trim({c})), '\\s+'), lambda w: w <> ''))"


SQL_TC = SQL_MAP + f""",
tk AS (SELECT e.vid, e.team AS ev_team, t.pos, t.threatened_color, t.collision,
   CASE WHEN t.team = e.team THEN 1000 WHEN lower(trim(t.team)) = lower(trim(e.team)) THEN 900
        WHEN len(list_intersect({sql_words('e.team')}, {sql_words('t.team')})) >= 0.5 * greatest(len({sql_words('e.team')}), len({sql_words('t.team')}))
        THEN len(list_intersect({sql_words('e.team')}, {sql_words('t.team')})) ELSE 0 END AS s
  FROM (SELECT DISTINCT vid, team FROM gt) e JOIN tm t ON t.vid = e.vid),
tc AS (SELECT vid, ev_team, arg_max(threatened_color, s * 10 - pos) FILTER (s > 0) AS expected_color, bool_or(collision) AS collision FROM tk GROUP BY 1, 2)"""
query("jon16_team_color", sql("games gt", SQL_TC + " SELECT g.vid, g.idx, c.expected_color, c.collision FROM gt g LEFT JOIN tc c ON c.vid = g.vid AND c.ev_team = g.team"))(
    lambda s, d: D.team_color(V.gt(s, d), tmap(s, d)).select("vid", "idx", "expected_color", "collision")
)
SQL_TOKS = "list_distinct(list_filter(list_transform(regexp_split_to_array(lower(trim({c})), '\\s+'), lambda w: regexp_replace(w, '[.,;:!?]+$', '')), lambda w: w <> ''))"


def sql_match(a, b):
    ta, tb = SQL_TOKS.format(c=a), SQL_TOKS.format(c=b)
    return (
        f"(lower(trim({a})) = lower(trim({b})) OR (len({ta}) >= 2 AND len({tb}) >= 2 AND "
        f"(len(list_intersect({ta}, {tb})) = len({ta}) OR len(list_intersect({ta}, {tb})) = len({tb}))))"
    )


SQL_SHOTS = SQL_MAP + f""",
seg AS (SELECT * FROM win WHERE source <> 'faceoff'),
fc AS (SELECT vid, arg_min(color, win_id) AS color FROM seg GROUP BY vid),
ft AS (SELECT f.vid, CASE WHEN count(t.team) = 1 THEN min(t.team) END AS team FROM fc f
  LEFT JOIN tm t ON t.vid = f.vid AND NOT t.collision AND len(list_intersect({sql_tok('t.threatened_color')}, {sql_tok('f.color')})) > 0 GROUP BY f.vid),
ps AS (SELECT vid, win_id * 2 + pos AS pred_id, CAST(least(start_s + off, end_s) AS double) AS t
  FROM (SELECT *, 0 AS pos, win_id % 5 AS off FROM seg UNION ALL SELECT *, 1, 7 FROM seg WHERE win_id % 3 = 0)),
gs0 AS (SELECT gt.vid, idx AS gt_id, start_s, end_s, 0.5::double * (start_s + end_s) AS mid FROM gt LEFT JOIN ft ON ft.vid = gt.vid
  WHERE action = 'Shots' AND (ft.team IS NULL OR {sql_match('gt.team', 'ft.team')})),
gs AS (SELECT *, EXISTS (SELECT 1 FROM seg WHERE seg.vid = gs0.vid AND mid BETWEEN seg.start_s AND seg.end_s) AS covered FROM gs0),
cd AS (SELECT p.vid, p.pred_id, p.t, list({{'gt_id': g.gt_id, 'cls': CASE WHEN p.t BETWEEN g.start_s AND g.end_s THEN 'inside' ELSE 'tolerance' END, 'd': abs(p.t - g.mid)}}
          ORDER BY g.start_s, g.gt_id) FILTER (g.gt_id IS NOT NULL) AS c
       FROM ps p LEFT JOIN gs g ON g.vid = p.vid AND g.covered AND p.t BETWEEN g.start_s - 3 AND g.end_s + 3 GROUP BY 1, 2, 3),
po AS (SELECT *, row_number() OVER (PARTITION BY vid ORDER BY t, pred_id) AS rn FROM cd),
sw AS (
  SELECT DISTINCT vid, CAST(0 AS bigint) AS rn, CAST([] AS bigint[]) AS used, CAST(NULL AS bigint) AS pred_id, CAST(NULL AS bigint) AS gt_id, CAST(NULL AS varchar) AS match_class FROM po
  UNION ALL
  SELECT vid, rn, CASE WHEN b.gt_id >= 0 THEN list_append(used, b.gt_id) ELSE used END, pred_id, nullif(b.gt_id, -1), nullif(b.cls, '')
  FROM (SELECT w.vid, p.rn, w.used, p.pred_id, list_reduce(list_concat([{{'gt_id': CAST(-1 AS bigint), 'cls': '', 'd': CAST(1e9 AS double)}}],
            list_filter(coalesce(p.c, []), lambda x: NOT list_contains(w.used, x.gt_id))),
          lambda a, x: CASE WHEN x.d < a.d AND (x.cls = 'inside' OR a.cls <> 'inside') THEN x ELSE a END) AS b
        FROM sw w JOIN po p ON p.vid = w.vid AND p.rn = w.rn + 1)),
sm AS (SELECT vid, pred_id, gt_id, match_class FROM sw WHERE rn > 0)"""


def shot_segments(spark, sf):
    """Segments with lists of shot times, some malformed, some beyond the end."""
    second = "case win_id % 3 when 0 then '0:7' when 1 then '00:75' else 'soon' end"
    shot = "named_struct('timestamp', {}, 'location', 'slot', 'release', 'wrist', 'outcome', cast(null as string))"
    return V.win(spark, sf).selectExpr(
        "vid", "win_id as ord", "start_s", "end_s", "source <> 'faceoff' as threat", "color",
        f"array({shot.format("concat('00:0', win_id % 5)")}, {shot.format(second)}) as shot_timestamps",
    )


def shot_inputs(spark, sf):
    """Shot predictions out of the lists, and ground-truth shots of the threatening team."""
    seg = shot_segments(spark, sf)
    g = M.shots_against(V.gt(spark, sf), seg, tmap(spark, sf)).withColumnRenamed("idx", "gt_id")
    return M.shot_list(seg), M.coverage(g, seg.filter("threat"))


def shot_matches(p, g):
    return M.match_shots(p, g.filter("covered"), 3.0)


query("jon8_match_shots", sql("win gt games", SQL_SHOTS + " SELECT vid, pred_id // 2 AS win_id, CAST(pred_id % 2 AS int) AS pos, gt_id, match_class FROM sm"))(
    lambda s, d: shot_matches(*shot_inputs(s, d)).select("vid", F.col("pred_id.ord").alias("win_id"), "pred_id.pos", "gt_id", "match_class")
)
SQL_SHOT_COUNTS = SQL_SHOTS + """,
sc AS (SELECT vid, coalesce(n_pred, 0) AS n_pred, coalesce(n_gt, 0) AS n_gt, coalesce(n_covered, 0) AS n_covered, coalesce(tp_strict, 0) AS tp_strict, coalesce(tp_lenient, 0) AS tp_lenient,
    coalesce(n_pred - tp_strict, 0) AS fp, coalesce(n_covered, 0) - coalesce(tp_lenient, 0) AS fn, coalesce(n_gt - n_covered, 0) AS fn_uncovered
  FROM (SELECT vid, count(*) AS n_pred, count(*) FILTER (match_class = 'inside') AS tp_strict, count(match_class) AS tp_lenient FROM sm GROUP BY vid)
  FULL JOIN (SELECT vid, count(*) AS n_gt, count(*) FILTER (covered) AS n_covered FROM gs GROUP BY vid) USING (vid))"""


def shot_eval(spark, sf):
    p, g = shot_inputs(spark, sf)
    g = cut(g)
    return M.shot_counts(shot_matches(p, g), g)


query("jon8_shot_counts", sql("win gt games", SQL_SHOT_COUNTS + " SELECT * FROM sc"))(shot_eval)
query("jon9_coverage", sql("win gt games", SQL_SHOTS.split("cd AS")[0].rstrip().rstrip(",") + " SELECT vid, gt_id, covered FROM gs"))(
    lambda s, d: shot_inputs(s, d)[1].select("vid", "gt_id", "covered")
)


SQL_RG = f"""
rg AS (SELECT g.* FROM gtm g LEFT JOIN games m ON m.vid = g.vid WHERE g.vid % 2 <> 0 OR m.vid IS NULL OR {sql_match('g.team', 'm.opponent_team')})"""


def meta(spark, sf):
    """Odd recordings were predicted without the target filter."""
    return V.games(spark, sf).selectExpr("vid", "vid % 2 = 0 as applied")


query("jon18_restrict_gt", sql("games gt", SQL_GT + "," + SQL_RG + " SELECT * FROM rg"))(
    lambda s, d: D.restrict_gt(gtm(s, d), V.games(s, d), meta(s, d))
)
SQL_WC = SQL_TT + f""",
wc AS (SELECT t.vid, t.win_id, t.start_s, t.end_s, t.color, t.target_team, count(g.idx) AS n_overlapping,
    count(g.idx) FILTER (g.action = 'Shots' AND (t.target_team IS NULL OR {sql_match('g.team', 't.target_team')})) AS gt_shots,
    count(g.idx) FILTER (g.action = 'Shots') AS gt_shots_unfiltered,
    count(g.idx) FILTER (g.action = 'Goals' AND (t.target_team IS NULL OR {sql_match('g.team', 't.target_team')})) AS gt_goals,
    count(g.idx) FILTER (g.action = 'Goals') AS gt_goals_unfiltered
  FROM tt t LEFT JOIN gt g ON g.vid = t.vid AND g.end_s > t.start_s AND g.start_s < t.end_s GROUP BY ALL)"""


def counted(spark, sf):
    seg = win_teams(spark, sf).select("vid", "win_id", "start_s", "end_s", "color", "target_team")
    return M.window_counts(seg, V.gt(spark, sf), block=BLK)


query("jon11_window_counts", sql("games win gt", SQL_WC + " SELECT vid, win_id, n_overlapping, gt_shots, gt_shots_unfiltered, gt_goals, gt_goals_unfiltered FROM wc"))(
    lambda s, d: counted(s, d).select("vid", "win_id", "n_overlapping", "gt_shots", "gt_shots_unfiltered", "gt_goals", "gt_goals_unfiltered")
)
query("jon22_crosswalk", sql("", """
ids AS (SELECT 'V' || o_custkey AS vid, min(o_orderkey) AS gt_id FROM orders GROUP BY 1),
x AS (SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'V' || o_custkey WHEN o_orderkey % 3 = 1 THEN CAST(o_orderkey AS varchar) ELSE 'none-' || o_orderkey END AS vid, o_orderkey FROM orders)
SELECT x.o_orderkey, coalesce(ids.gt_id, TRY_CAST(x.vid AS bigint)) AS gt_id FROM x LEFT JOIN ids USING (vid) WHERE coalesce(ids.gt_id, TRY_CAST(x.vid AS bigint)) IS NOT NULL"""))(
    lambda s, d: D.crosswalk(
        V.table(s, d, "orders").selectExpr(
            "case o_orderkey % 3 when 0 then concat('V', o_custkey) when 1 then cast(o_orderkey as string) else concat('none-', o_orderkey) end as vid", "o_orderkey"
        ),
        V.table(s, d, "orders").groupBy(F.expr("concat('V', o_custkey)").alias("vid")).agg(F.min("o_orderkey").alias("gt_id")),
    ).select("o_orderkey", "gt_id")
)
query("jon23_merge_maps", sql("", """
u AS (SELECT c_custkey AS vid, c_mktsegment AS color, 0 AS src FROM customer
      UNION ALL SELECT o_custkey, min(o_orderpriority), 1 FROM orders GROUP BY 1)
SELECT vid, arg_max(color, src) AS color, count(DISTINCT src) > 1 AS overlapping FROM u GROUP BY vid"""))(
    lambda s, d: D.merge_maps(
        "vid",
        V.table(s, d, "customer").selectExpr("c_custkey as vid", "c_mktsegment as color"),
        V.table(s, d, "orders").groupBy(F.col("o_custkey").alias("vid")).agg(F.min("o_orderpriority").alias("color")),
    )
)
query("agg26_team_roles", sql("gt", """
c AS (SELECT vid, team, count(*) AS n, min(idx) AS f FROM gt WHERE action IN ('Shots','Goals') GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY vid ORDER BY n DESC, f) AS r FROM c)
SELECT a.vid, a.team AS target_team, b.team AS opponent_team FROM r a JOIN r b ON a.vid = b.vid AND a.r = 1 AND b.r = 2"""))(
    lambda s, d: D.team_roles(V.gt(s, d))
)
query("agg27_shot_counts", sql("gt", "SELECT vid, count(*) AS n_threats FROM gt GROUP BY vid"))(lambda s, d: D.shot_rows(V.gt(s, d)))

# -- evaluation jobs -------------------------------------------------------------


def sql_prf(tp="tp", fp="fp", fn="fn"):
    p, r = f"coalesce({tp} / nullif(CAST({tp} + {fp} AS double), 0), 0)", f"coalesce({tp} / nullif(CAST({tp} + {fn} AS double), 0), 0)"
    return f"round_even({p}, 4) AS p, round_even({r}, 4) AS r, round_even(coalesce(2 * {p} * {r} / nullif({p} + {r}, 0), 0), 4) AS f1"


SQL_POOL = """,
pv AS (SELECT g.vid, coalesce(tp, 0) AS tp, coalesce(n_pred, 0) - coalesce(tp, 0) AS fp, n_gt - coalesce(tp, 0) AS fn, n_gt, coalesce(n_pred, 0) AS n_pred
  FROM (SELECT v.vid, count(gtm.vid) AS n_gt FROM (SELECT DISTINCT vid FROM gt) v LEFT JOIN gtm ON gtm.vid = v.vid GROUP BY 1) g LEFT JOIN (SELECT vid, count(*) AS n_pred FROM pr GROUP BY 1) p USING (vid)
  LEFT JOIN (SELECT vid, count(*) AS tp FROM mt GROUP BY 1) m USING (vid)),
ps AS (SELECT vid, CAST(sum(tp) AS bigint) AS tp, CAST(sum(fp) AS bigint) AS fp, CAST(sum(fn) AS bigint) AS fn, CAST(sum(n_gt) AS bigint) AS n_gt, CAST(sum(n_pred) AS bigint) AS n_pred FROM pv GROUP BY ROLLUP (vid))
SELECT *, """ + sql_prf() + " FROM ps"
query("agg3_eval_strict", sql("probs gt", SQL_M + SQL_POOL))(
    lambda s, d: E.eval_strict(V.gt(s, d), preds(s, d), THR, 2, 2, BLK)
)
query("agg4_eval_spotting", sql("probs gt", SQL_MID + SQL_POOL))(
    lambda s, d: E.eval_spotting(V.gt(s, d), preds(s, d), 5.0, 2, BLK)
)
query("agg1_prf", sql("probs gt", SQL_M + SQL_POOL + " WHERE vid IS NOT NULL"))(
    lambda s, d: E.pooled(
        E.counts(V.gt(s, d), padded(s, d), p := preds(s, d), M.match_iou(padded(s, d), p, THR, BLK))
    ).filter("vid is not null")
)
SQL_RECALL = SQL_CAND + "," + SQL_GT + """,
rm AS (SELECT vid, 0.5::double * (start_s + end_s) AS mid FROM gtm),
rc AS (SELECT vid, count(*) AS n_gt,
   count(*) FILTER (EXISTS (SELECT 1 FROM cand c WHERE c.vid = rm.vid AND abs(c.t_seconds - mid) <= 5)) AS hits_5s,
   count(*) FILTER (EXISTS (SELECT 1 FROM cand c WHERE c.vid = rm.vid AND abs(c.t_seconds - mid) <= 10)) AS hits_10s FROM rm GROUP BY vid)"""
query("agg5_recall_at", sql("probs gt", SQL_RECALL + " SELECT *, round(hits_5s / n_gt, 6) AS recall_5s, round(hits_10s / n_gt, 6) AS recall_10s FROM rc"))(
    lambda s, d: r6(E.recall_at(cands(s, d), gtm(s, d)), "recall_5s", "recall_10s")
)
query("agg6_candidate_report", sql("probs gt", SQL_RECALL + SQL_ANN[len(SQL_CAND) + 1 + len(SQL_GT) :] + """,
du AS (SELECT vid, max(t) AS duration FROM fused GROUP BY vid)
SELECT a.vid, count(*) AS n_candidates, any_value(coalesce(n_gt, 0)) AS n_gt, any_value(round(coalesce(hits_5s / n_gt, 0), 6)) AS recall_5s,
  any_value(round(coalesce(hits_10s / n_gt, 0), 6)) AS recall_10s, count(*) FILTER (gt_match_t_seconds IS NULL) AS n_fp_at_5s, any_value(duration) AS duration,
  round(count(*) / greatest(1.0::double, any_value(duration) / 60), 6) AS cand_per_min
FROM ann a LEFT JOIN rc USING (vid) LEFT JOIN du USING (vid) GROUP BY a.vid"""))(
    lambda s, d: r6(
        E.candidate_report(cands(s, d), gtm(s, d), S.duration(fused(s, d)), BLK), "recall_5s", "recall_10s", "cand_per_min"
    )
)
query("top1_top_fp", sql("probs gt", SQL_ANN + """
SELECT confidence, vid, t_mmss FROM ann WHERE gt_match_t_seconds IS NULL ORDER BY confidence DESC, CAST(vid AS varchar) DESC, t_mmss DESC LIMIT 10"""))(
    lambda s, d: E.top_false_positives(annotated(s, d), 10)
)
query("top2_sample_top", sql("probs", SQL_CAND + " SELECT * FROM cand WHERE rank <= 10"))(lambda s, d: E.sample_top(cands(s, d), 10))

SQL_EV = SQL_P + "," + SQL_RG + "," + SQL_TC + "," + SQL_IOU.replace("{pad}", "2").replace("{gt}", "rg").replace("{thr}", "0.2") + f""",
ej AS (SELECT coalesce(g.vid, p.vid) AS vid, g.gt_id, g.start_s AS gt_start, g.end_s AS gt_end, g.team AS gt_team, p.start_s AS pred_start, p.end_s AS pred_end, p.color AS pred_color, m.score
  FROM rg g LEFT JOIN mt m ON m.vid = g.vid AND m.gt_id = g.gt_id FULL JOIN pr p ON p.vid = g.vid AND p.pred_id = m.pred_id),
evr AS (SELECT e.vid, CASE WHEN gt_start IS NULL THEN 'fp' WHEN pred_start IS NULL THEN 'fn' ELSE 'match' END AS kind, gt_start, gt_end, gt_team, pred_start, pred_end, pred_color,
  round_even(coalesce(score, 0.0), 3) AS iou,
  CASE WHEN score IS NOT NULL THEN round_even(greatest(least(gt_end, pred_end) - greatest(gt_start, pred_start), 0) / CAST((gt_end - gt_start) + (pred_end - pred_start) - greatest(least(gt_end, pred_end) - greatest(gt_start, pred_start), 0) AS double), 3) END AS iou_raw,
  CASE WHEN gt_start IS NULL THEN 'n/a (FP)' WHEN pred_start IS NULL THEN 'n/a (FN)'
       WHEN coalesce(c.collision, true) OR c.expected_color IS NULL THEN 'skipped' WHEN pred_color IS NULL THEN 'missing_color'
       WHEN len(list_intersect({sql_tok('pred_color')}, {sql_tok('c.expected_color')})) > 0 THEN 'correct'
       ELSE 'wrong (expected ' || c.expected_color || ')' END AS attribution
  FROM ej e LEFT JOIN tc c ON c.vid = e.vid AND c.ev_team = e.gt_team)"""


def evaluated(spark, sf):
    return E.evaluate(gtm(spark, sf), preds(spark, sf), V.games(spark, sf), meta(spark, sf), THR, 2, BLK)


def gt_eval(spark, sf):
    return D.restrict_gt(gtm(spark, sf), V.games(spark, sf), meta(spark, sf))


query("agg7_evaluate", sql("probs gt games", SQL_EV + " SELECT * FROM evr"))(evaluated)
query("agg2_aggregate_eval", sql("probs gt games", SQL_EV + "," + SQL_HITS.format(gt="rg") + """,
pe AS (SELECT vid, count(*) FILTER (kind = 'match') AS tp, count(*) FILTER (kind = 'fp') AS fp, count(*) FILTER (kind = 'fn') AS fn,
   count(*) FILTER (attribution = 'correct') AS attr_correct, count(*) FILTER (attribution LIKE 'wrong%') AS attr_wrong,
   count(*) FILTER (attribution IN ('skipped','missing_color')) AS attr_skipped FROM evr GROUP BY vid),
ra AS (SELECT vid, CAST(sum(tp) AS bigint) AS tp, CAST(sum(fp) AS bigint) AS fp, CAST(sum(fn) AS bigint) AS fn, CAST(sum(attr_correct) AS bigint) AS attr_correct,
   CAST(sum(attr_wrong) AS bigint) AS attr_wrong, CAST(sum(attr_skipped) AS bigint) AS attr_skipped, CAST(sum(coalesce(gt_hits,0)) AS bigint) AS gt_hits, CAST(sum(coalesce(gt_total,0)) AS bigint) AS gt_total,
   CAST(sum(coalesce(pred_hits,0)) AS bigint) AS pred_hits, CAST(sum(coalesce(pred_total,0)) AS bigint) AS pred_total, count(*) AS videos FROM pe LEFT JOIN hits USING (vid) GROUP BY ROLLUP (vid)),
rb AS (SELECT *, gt_hits / nullif(gt_total::double, 0) AS mr, pred_hits / nullif(pred_total::double, 0) AS mp FROM ra)
SELECT * EXCLUDE (mr, mp), """ + sql_prf() + """, round_even(attr_correct / nullif((attr_correct + attr_wrong)::double, 0), 4) AS attribution_accuracy,
  round_even(mr, 4) AS midpoint_recall, round_even(mp, 4) AS midpoint_precision, round_even(CASE WHEN mr + mp > 0 THEN 2 * mp * mr / (mp + mr) END, 4) AS midpoint_f1 FROM rb"""))(
    lambda s, d: E.aggregate_eval(evaluated(s, d), M.midpoint_hits(gt_eval(s, d), preds(s, d)))
)
SQL_DIAG = SQL_EV + """,
fg AS (SELECT * FROM rg g WHERE NOT EXISTS (SELECT 1 FROM evr e WHERE e.kind = 'match' AND e.vid = g.vid AND e.gt_start = g.start_s AND e.gt_end = g.end_s)),
fq AS (SELECT * FROM pr p WHERE NOT EXISTS (SELECT 1 FROM evr e WHERE e.kind = 'match' AND e.vid = p.vid AND e.pred_start = p.start_s AND e.pred_end = p.end_s)),
nn AS (SELECT g.vid, 'FN' AS kind, g.gt_id AS id, g.start_s, g.end_s, p.pred_id AS oid, p.start_s AS ns, p.end_s AS ne FROM fg g LEFT JOIN fq p ON p.vid = g.vid
       UNION ALL SELECT p.vid, 'FP', p.pred_id, p.start_s, p.end_s, g.gt_id, g.start_s, g.end_s FROM fq p LEFT JOIN fg g ON p.vid = g.vid),
nd AS (SELECT *, abs(0.5::double * (start_s + end_s) - 0.5::double * (ns + ne)) AS dist,
   coalesce(greatest(least(end_s, ne) - greatest(start_s, ns), 0) / nullif(CAST((end_s - start_s) + (ne - ns) - greatest(least(end_s, ne) - greatest(start_s, ns), 0) AS double), 0), 0) AS iou FROM nn),
n1 AS (SELECT *, row_number() OVER (PARTITION BY vid, kind, id ORDER BY dist, oid) AS rn FROM nd),
diag AS (SELECT vid, kind, start_s, end_s, ns AS near_start, ne AS near_end, round_even(dist, 1) AS delta, CASE WHEN ns IS NOT NULL THEN round_even(iou, 3) END AS iou,
  CASE WHEN ns IS NULL THEN CASE WHEN kind = 'FN' THEN 'no_pred' ELSE 'no_gt' END
       WHEN dist > 30 THEN CASE WHEN kind = 'FN' THEN 'missed_entirely' ELSE 'spurious' END WHEN iou >= 0.05 THEN 'scale_mismatch'
       WHEN kind = 'FN' THEN 'no_spatial_overlap' ELSE 'adjacent_to_gt' END AS class FROM n1 WHERE rn = 1)"""


def diagnosed(spark, sf):
    return E.diagnose(evaluated(spark, sf), gt_eval(spark, sf), preds(spark, sf))


query("agg8_diagnose", sql("probs gt games", SQL_DIAG + " SELECT * FROM diag"))(diagnosed)
query("agg8_diagnose_summary", sql("probs gt games", SQL_DIAG + " SELECT kind, class, count(*) AS n FROM diag GROUP BY 1, 2"))(
    lambda s, d: E.diagnose_summary(diagnosed(s, d))
)
SQL_Q = """
SELECT count(*) AS n, min({c}) AS min, list_sort(list({c}))[count(*) // 4 + 1] AS p25, list_sort(list({c}))[count(*) // 2 + 1] AS median,
  list_sort(list({c}))[3 * count(*) // 4 + 1] AS p75, max({c}) AS max, round(avg({c}), 6) AS mean FROM {t}"""
query("agg9_index_quantiles", sql("probs gt games", SQL_DIAG + ", q AS (SELECT iou FROM diag WHERE class = 'scale_mismatch')" + SQL_Q.format(c="iou", t="q")))(
    lambda s, d: r6(E.index_quantiles(diagnosed(s, d).filter("class = 'scale_mismatch'"), "iou"), "mean")
)
query("agg33_offset_stats", sql("probs gt", SQL_MID + SQL_Q.format(c="score", t="mt")))(
    lambda s, d: r6(E.offset_stats(tol_matches(s, d)), "mean")
)
SQL_FPT = SQL_EV + SQL_TL[len(SQL_WINDOWS) :] + """,
fpt AS (SELECT e.vid, e.pred_start AS start_s, e.pred_end AS end_s, src, CASE WHEN len(src) > 0 THEN array_to_string(src, '+') ELSE '(no_trace)' END AS combo, n_raw
  FROM evr e JOIN tl ON tl.vid = e.vid AND tl.start_s = e.pred_start AND tl.end_s = e.pred_end WHERE kind = 'fp')"""


def fp_traced(spark, sf):
    return E.fp_trace(evaluated(spark, sf), trace_table(spark, sf), BLK)


query("agg10_fp_trace", sql("probs gt games win", SQL_FPT + " SELECT vid, start_s, end_s, combo, n_raw FROM fpt"))(
    lambda s, d: fp_traced(s, d).select("vid", "start_s", "end_s", "combo", "n_raw")
)
query("agg10_fp_by_combo", sql("probs gt games win", SQL_FPT + " SELECT combo, count(*) AS n FROM fpt GROUP BY 1"))(lambda s, d: E.fp_by_combo(fp_traced(s, d)))
query("agg10_fp_by_signal", sql("probs gt games win", SQL_FPT + " SELECT signal, count(*) AS n FROM (SELECT unnest(src) AS signal FROM fpt) GROUP BY 1"))(
    lambda s, d: E.fp_by_signal(fp_traced(s, d))
)
query("agg10_fp_top_combos", sql("probs gt games win", SQL_FPT + """,
c AS (SELECT vid, combo, count(*) AS n, min(start_s) AS f FROM fpt GROUP BY 1, 2)
SELECT vid, combo, n, CAST(r AS int) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY vid ORDER BY n DESC, f) AS r FROM c) WHERE r <= 3"""))(
    lambda s, d: E.fp_top_combos(fp_traced(s, d), 3)
)
query("set1_intersect", sql("games gt", "SELECT vid FROM games INTERSECT SELECT vid FROM gt"))(
    lambda s, d: V.games(s, d).select("vid").intersect(V.gt(s, d).select("vid"))
)
query("set2_except", sql("games gt", "SELECT vid FROM games EXCEPT SELECT vid FROM gt"))(
    lambda s, d: V.games(s, d).select("vid").join(V.gt(s, d).select("vid").distinct(), "vid", "left_anti")
)
query("set4_unmatched", sql("probs gt", SQL_M + """
SELECT 'gt' AS side, vid, gt_id AS id FROM gtm g WHERE NOT EXISTS (SELECT 1 FROM mt m WHERE m.vid = g.vid AND m.gt_id = g.gt_id)
UNION ALL SELECT 'pred', vid, pred_id FROM pr p WHERE NOT EXISTS (SELECT 1 FROM mt m WHERE m.vid = p.vid AND m.pred_id = p.pred_id)"""))(
    lambda s, d: M.unmatched(gtm(s, d), M.match_iou(padded(s, d), preds(s, d), THR, BLK), "gt_id")
    .select(F.lit("gt").alias("side"), "vid", F.col("gt_id").alias("id"))
    .unionByName(
        M.unmatched(preds(s, d), M.match_iou(padded(s, d), preds(s, d), THR, BLK), "pred_id").select(
            F.lit("pred").alias("side"), "vid", F.col("pred_id").alias("id")
        )
    )
)
