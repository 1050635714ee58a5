"""Clip-record queries: reply clean-up, votes, refinement, reconciliation."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import views as V
from ..functions import labels as L
from ..operators import intervals as I, records as R
from ..views import BLK, sql
from .registry import query
from .series import SQL_FUSE, fused

# -- raw metric replies: one per order, one shot per line item ------------------
SQL_REPLY = """
sh AS (SELECT l_orderkey AS o, l_linenumber * 10000000::bigint + l_partkey AS k,
    lpad(CAST(floor(l_quantity) AS int) // 60 || '', 2, '0') || ':' || lpad((CAST(floor(l_quantity) AS int) + 15) % 70 || '', 2, '0') AS ts,
    CASE l_returnflag WHEN 'R' THEN 'goal' WHEN 'A' THEN 'save' ELSE 'wide' END AS outcome,
    CASE WHEN l_linenumber = 7 OR l_linenumber % 5 = 0 THEN NULL ELSE l_linestatus = 'F' OR l_quantity > 20 END AS f1, CASE WHEN l_linenumber = 7 THEN NULL ELSE l_quantity > 25 END AS f2,
    CASE WHEN l_linenumber = 7 THEN NULL ELSE l_tax > 0.04 END AS f3, CASE WHEN l_linenumber = 7 THEN NULL ELSE l_discount > 0.085 END AS f4 FROM lineitem),
og AS (SELECT o, list({'ts': ts, 'outcome': outcome, 'f1': f1, 'f2': f2, 'f3': f3, 'f4': f4} ORDER BY k, ts, outcome, f1, f2, f3, f4) AS sl, count(*) AS n,
    count(*) FILTER (outcome <> 'wide') AS g0, count(*) FILTER (outcome = 'goal') AS g1 FROM sh GROUP BY o),
rep AS (SELECT o AS seg_id, o % 50 AS vid, sl, CAST(n - CASE WHEN o % 3 = 0 THEN 1 ELSE 0 END AS int) AS shots, CAST(g0 AS int) AS sog, CAST(least(g1, 2) AS int) AS goals,
    CAST(g0 - least(g1, 2) - CASE WHEN o % 4 = 0 THEN 1 ELSE 0 END AS int) AS saves,
    CASE o % 6 WHEN 0 THEN '' WHEN 1 THEN 'I believe the puck crossed the line here' WHEN 2 THEN 'short text' ELSE 'Number 17 beats the goalie high {glove side' END AS detail,
    o % 5 <> 0 OR o % 7 = 0 OR o % 6 >= 3 AS x FROM og)"""


def replies(spark, sf):
    """Raw reply text: clean, with trailing chatter, cut off, or with a brace in a string."""
    li = V.table(spark, sf, "lineitem").selectExpr(
        "l_orderkey as o", "l_linenumber * 10000000L + l_partkey as k",
        "concat(lpad(cast(floor(l_quantity) as int) div 60, 2, '0'), ':', lpad((cast(floor(l_quantity) as int) + 15) % 70, 2, '0')) as timestamp",
        "case l_returnflag when 'R' then 'goal' when 'A' then 'save' else 'wide' end as outcome",
        "case when l_linenumber = 7 or l_linenumber % 5 = 0 then null else l_linestatus = 'F' or l_quantity > 20 end as feature_puck_traveling_toward_net",
        "case when l_linenumber = 7 then null else l_quantity > 25 end as feature_puck_release_frame_visible",
        "case when l_linenumber = 7 then null else l_tax > 0.04 end as feature_puck_impact_sound_audible",
        "case when l_linenumber = 7 then null else l_discount > 0.085 end as feature_puck_carrier_holds_or_passes",
    )
    shot = ["timestamp", "outcome", "feature_puck_traveling_toward_net", "feature_puck_release_frame_visible", "feature_puck_impact_sound_audible", "feature_puck_carrier_holds_or_passes"]
    g = li.groupBy("o").agg(
        F.array_sort(F.collect_list(F.struct("k", *shot))).alias("sl"), F.count("*").alias("n"),
        F.count_if(F.col("outcome") != "wide").alias("g0"), F.count_if(F.col("outcome") == "goal").alias("g1"),
    )
    body = g.selectExpr(
        "o", "cast(n - if(o % 3 = 0, 1, 0) as int) as shots", "cast(g0 as int) as shotsOnNet", "cast(least(g1, 2) as int) as goals",
        "cast(g0 - least(g1, 2) - if(o % 4 = 0, 1, 0) as int) as saves",
        f"transform(sl, s -> named_struct({', '.join(f'{chr(39)}{c}{chr(39)}, s.{c}' for c in shot)})) as shot_timestamps",
        "named_struct('anchor_puck_crosses_line', o % 2 = 0, 'support_whistle', o % 3 = 0, 'support_celebration', o % 5 = 0, 'confirming_detail', "
        "case o % 6 when 0 then '' when 1 then 'I believe the puck crossed the line here' when 2 then 'short text' else 'Number 17 beats the goalie high {glove side' end) as goal_criteria",
    )
    text = F.to_json(F.struct("shots", "shotsOnNet", "goals", "saves", "shot_timestamps", "goal_criteria"))
    raw = (
        F.when(F.expr("o % 7 = 0"), F.expr("substr(__j, 1, length(__j) - 1)"))
        .when(F.expr("o % 5 = 0"), F.concat(F.col("__j"), F.lit(" Hope } this helps")))
        .otherwise(F.col("__j"))
    )
    return body.withColumn("__j", text).select(F.col("o").alias("seg_id"), F.expr("o % 50 as vid"), raw.alias("raw"))


# a brace inside the description is only harmless while the text is intact
SQL_CLEAN = SQL_REPLY + """,
c0 AS (SELECT seg_id, vid, CASE WHEN seg_id % 7 = 0 THEN 'failed' WHEN seg_id % 5 <> 0 THEN 'ok' WHEN seg_id % 6 >= 3 THEN 'failed' ELSE 'recovered' END AS st, sl, shots, sog, saves, goals, detail FROM rep),
c1 AS (SELECT seg_id, vid, st AS parse_state, CASE WHEN st <> 'failed' THEN sl END AS sl, CASE WHEN st = 'failed' THEN 0 ELSE shots END AS shots, CASE WHEN st = 'failed' THEN 0 ELSE saves + goals END AS sog,
   CASE WHEN st = 'failed' THEN 0 ELSE saves END AS saves, CASE WHEN st = 'failed' THEN 0 ELSE goals END AS goals, CASE WHEN st <> 'failed' THEN detail END AS detail, st <> 'failed' AND sog <> saves + goals AS fixed_identity FROM c0),
c2 AS (SELECT * REPLACE (CASE WHEN len(sl) > shots THEN sl[1:shots] ELSE sl END AS sl), coalesce(len(sl) > shots, false) AS truncated, goals AS claimed FROM c1),
c3 AS (SELECT *, CASE WHEN goals = 0 THEN coalesce(len(list_filter(sl, lambda s: s.outcome = 'goal')), 0) ELSE 0 END AS demoted FROM c2),
c4 AS (SELECT *, coalesce(len(list_filter(sl, lambda s: NOT (s.f1 IS NULL AND s.f2 IS NULL AND s.f3 IS NULL AND s.f4 IS NULL) AND s.f1 IS NOT DISTINCT FROM false)), 0) AS pr,
   coalesce(len(list_filter(sl, lambda s: s.f1 IS DISTINCT FROM false AND s.f4 IS NOT DISTINCT FROM true)), 0) AS pd,
   coalesce(len(list_filter(sl, lambda s: s.f1 IS DISTINCT FROM false AND s.f4 IS DISTINCT FROM true AND s.f2 IS NOT DISTINCT FROM false AND s.f3 IS NOT DISTINCT FROM false)), 0) AS pn,
   list_filter(sl, lambda s: NOT (s.f1 IS NOT DISTINCT FROM false OR s.f4 IS NOT DISTINCT FROM true OR (s.f2 IS NOT DISTINCT FROM false AND s.f3 IS NOT DISTINCT FROM false))) AS kl FROM c3),
c5 AS (SELECT *, pr + pd + pn > 0 AS pa, CASE WHEN pr + pd + pn > 0 THEN len(kl) ELSE shots END AS shots2 FROM c4),
c6 AS (SELECT *, CASE WHEN pa THEN least(sog, shots2) ELSE sog END AS sog2 FROM c5),
c7 AS (SELECT *, CASE WHEN pa THEN least(goals, sog2) ELSE goals END AS goals2 FROM c6),
c8 AS (SELECT *, CASE WHEN pa THEN greatest(sog2 - goals2, 0) ELSE saves END AS saves2, claimed >= 1 AND seg_id % 6 < 3 AS dg FROM c7),
cl AS (SELECT seg_id, vid, parse_state, CAST(shots2 AS int) AS shots, CAST(sog2 AS int) AS sog, CAST(CASE WHEN dg THEN greatest(sog2, 0) ELSE saves2 END AS int) AS saves, CAST(CASE WHEN dg THEN 0 ELSE goals2 END AS int) AS goals,
   array_to_string(list_transform(kl, lambda s: s.ts || '=' || CASE WHEN s.outcome = 'goal' AND (dg OR claimed = 0) THEN 'save' ELSE s.outcome END), ',') AS entries,
   CASE WHEN parse_state = 'failed' THEN '' ELSE CASE WHEN seg_id % 2 = 0 THEN 'anchor_puck_crosses_line' ELSE '' END END AS anchors,
   fixed_identity, truncated, demoted, pr, pd, pn, dg FROM c8)"""


def cleaned(spark, sf):
    return R.clean_metrics(replies(spark, sf))


query("cln1_clean_metrics", sql("", SQL_CLEAN + " SELECT seg_id, vid, parse_state, shots, sog, saves, goals, entries, anchors FROM cl"))(
    lambda s, d: cleaned(s, d).select(
        "seg_id", "vid", "parse_state", "shots", "sog", "saves", "goals",
        F.array_join(F.transform("shot_timestamps", lambda x: F.concat(x["timestamp"], F.lit("="), x["outcome"])), ",").alias("entries"),
        F.coalesce(F.array_join("anchors", ","), F.lit("")).alias("anchors"),
    )
)
query("cln1_rule_hits", sql("", SQL_CLEAN + """
SELECT vid, count(*) AS replies, count(*) FILTER (parse_state = 'recovered') AS recovered, count(*) FILTER (parse_state = 'failed') AS failed, count(*) FILTER (fixed_identity) AS fixed_identity,
  count(*) FILTER (truncated) AS truncated, CAST(sum(demoted) AS bigint) AS demoted, CAST(sum(pr) AS bigint) AS pruned_required, CAST(sum(pd) AS bigint) AS pruned_disqualifier,
  CAST(sum(pn) AS bigint) AS pruned_no_evidence, count(*) FILTER (dg) AS downgraded FROM cl GROUP BY vid"""))(
    lambda s, d: R.rule_hits(cleaned(s, d))
)
query("sca22_fix_identity", sql("calls", "SELECT seg_id, call_no, CAST(greatest(shots - sog, 0) + goals AS int) AS sog, sog <> greatest(shots - sog, 0) + goals AS fixed_identity FROM calls"))(
    lambda s, d: R.fix_identity(V.calls(s, d).withColumn("saves", F.greatest(F.col("shots") - F.col("sog"), F.lit(0)))).select("seg_id", "call_no", "sog", "fixed_identity")
)

# -- gating ----------------------------------------------------------------------
query("flt7_null_metrics", sql("probs win", SQL_FUSE + """,
pk AS (SELECT w.win_id, max(p) AS peak FROM win w JOIN fused f ON f.vid = w.vid AND f.t BETWEEN w.start_s AND w.end_s GROUP BY 1),
g AS (SELECT vid, win_id, coalesce(peak, 0) AS peak FROM win LEFT JOIN pk USING (win_id) WHERE vid IN (SELECT vid FROM fused) UNION ALL SELECT vid, win_id, 1.0 FROM win WHERE vid NOT IN (SELECT vid FROM fused))
SELECT vid, win_id, CASE WHEN peak < 0.2 THEN 0 END AS shots, CASE WHEN peak < 0.2 THEN true END AS marker, CASE WHEN peak < 0.2 THEN CAST(round_even(CAST(CAST(peak AS varchar) AS decimal(38,20)), 4) AS double) END AS peak FROM g"""))(
    lambda s, d: R.null_metrics(I.gate_windows(V.win(s, d), fused(s, d), 0.2, BLK)).select(
        "vid", "win_id", "metrics.shots", F.col("metrics.prefilter_skip").alias("marker"), F.col("metrics.prefilter_peak_conf").alias("peak")
    )
)
query("flt8_screen_skip", sql("ev", """
SELECT event_id, (event_type <> 'error') AND event_type NOT IN ('purchase') AND event_type <> 'signup' AND value / 100 >= 0.7 AS skip FROM ev"""))(
    lambda s, d: R.screen_skip(
        V.ev(s, d).selectExpr(
            "event_id", "event_type = 'error' as failed", "event_type = 'purchase' as shots_any", "event_type = 'signup' as goal_likely", "value / 100 as confidence"
        )
    ).select("event_id", "skip")
)
query("jon21_with_metrics", sql("", SQL_CLEAN + """
SELECT o_orderkey AS seg_id, o_custkey % 50 AS vid, c.shots, c.goals FROM orders LEFT JOIN cl c ON c.seg_id = o_orderkey AND c.vid = o_custkey % 50"""))(
    lambda s, d: R.with_metrics(
        V.table(s, d, "orders").selectExpr("o_orderkey as seg_id", "o_custkey % 50 as vid"),
        cleaned(s, d).select("vid", "seg_id", F.struct("shots", "goals").alias("metrics")),
    ).select("seg_id", "vid", "metrics.shots", "metrics.goals")
)

# -- votes -------------------------------------------------------------------------
SQL_VOTES = """
cc AS (SELECT *, greatest(sog - goals, 0) AS saves FROM calls),
g AS (SELECT seg_id, arg_min({'shots': shots, 'sog': sog, 'saves': saves, 'goals': goals}, call_no) AS f, count(*) AS n, list_sort(list(shots))[(count(*) + 1) // 2] AS ms, list_sort(list(sog))[(count(*) + 1) // 2] AS mg,
   count(*) FILTER (goals >= 1) AS yes FROM cc GROUP BY seg_id),
v AS (SELECT *, f.shots > 4 AS sv, f.goals >= 1 AS gv, n > 1 AND (f.shots > 4 OR f.goals >= 1) AS voted FROM g),
w AS (SELECT *, CASE WHEN voted AND gv AND yes < 2 THEN 0 ELSE f.goals END AS goals, CASE WHEN voted AND sv THEN least(mg, ms) ELSE f.sog END AS sog0 FROM v),
x AS (SELECT *, CASE WHEN voted THEN greatest(sog0, goals) ELSE sog0 END AS sog FROM w),
votes AS (SELECT seg_id, n AS n_calls, CASE WHEN voted AND sv THEN ms ELSE f.shots END AS shots, sog, CASE WHEN voted THEN greatest(sog - goals, 0) ELSE f.saves END AS saves, goals,
  sv AS shot_vote_triggered, gv AS goal_vote_triggered, CASE WHEN sv THEN CASE WHEN n = 1 THEN 'extras_failed' ELSE 'applied' END END AS shot_vote_outcome,
  CASE WHEN gv THEN CASE WHEN n = 1 THEN 'extras_failed' WHEN yes >= 2 THEN 'kept' ELSE 'rejected' END END AS goal_vote_outcome FROM x)"""


def votes(spark, sf):
    return R.resolve_votes(V.calls(spark, sf).withColumn("saves", F.greatest(F.col("sog") - F.col("goals"), F.lit(0))))


query("agg19_resolve_votes", sql("calls", SQL_VOTES + " SELECT * FROM votes"))(votes)
query("agg20_vote_summary", sql("calls", SQL_VOTES + """
SELECT count(*) AS n_segments, CAST(sum(n_calls) AS bigint) AS total_calls, round_even(sum(n_calls) / count(*)::double, 3) AS cost_ratio, count(*) FILTER (shot_vote_triggered) AS shot_vote_fired,
  round_even(100.0::double * count(*) FILTER (shot_vote_triggered) / count(*), 1) AS shot_vote_pct, count(*) FILTER (goal_vote_triggered) AS goal_vote_fired,
  round_even(100.0::double * count(*) FILTER (goal_vote_triggered) / count(*), 1) AS goal_vote_pct, count(*) FILTER (goal_vote_outcome = 'kept') AS goal_vote_kept, count(*) FILTER (goal_vote_outcome = 'rejected') AS goal_vote_rejected FROM votes"""))(
    lambda s, d: R.vote_summary(votes(s, d))
)

# -- totals, calibration -------------------------------------------------------------
query("agg21_game_totals", sql("clips gt", """
p AS (SELECT vid, CAST(sum(shots) AS bigint) AS shots, CAST(sum(sog) AS bigint) AS sog, CAST(sum(saves) AS bigint) AS saves, CAST(sum(goals) AS bigint) AS goals FROM clips GROUP BY vid),
t AS (SELECT vid, count(*) FILTER (action = 'Shots') AS gt_sog, count(*) FILTER (action = 'Goals') AS gt_goals, greatest(count(*) FILTER (action = 'Shots') - count(*) FILTER (action = 'Goals'), 0) AS gt_saves FROM gt GROUP BY vid),
u AS (SELECT p.*, gt_sog AS gt_shots, gt_sog, gt_saves, gt_goals FROM p LEFT JOIN t USING (vid))
SELECT *, shots - gt_shots AS delta_shots, sog - gt_sog AS delta_sog, saves - gt_saves AS delta_saves, goals - gt_goals AS delta_goals FROM u"""))(
    lambda s, d: R.game_totals(V.clips(s, d), V.gt(s, d))
)
query("agg22_calibrate", sql("runlog ev", """
l AS (SELECT *, row_number() OVER (PARTITION BY vid, field ORDER BY ts DESC, event_id DESC) AS r FROM runlog),
m AS (SELECT vid, field, median(delta) AS median_delta FROM l WHERE r <= 5 GROUP BY 1, 2),
p AS (SELECT vid, event_type AS field, count(*) AS value FROM ev GROUP BY 1, 2)
SELECT vid, field, value, median_delta, CAST(greatest(round_even(value - median_delta, 0), 0) AS bigint) AS calibrated FROM p LEFT JOIN m USING (vid, field)"""))(
    lambda s, d: R.calibrate(V.runlog(s, d), V.ev(s, d).groupBy("vid", F.col("event_type").alias("field")).agg(F.count("*").alias("value")), 5)
)

# -- refinement ------------------------------------------------------------------------
def sql_refine(pre: int, post: int, width: int) -> str:
    """Refined bounds ``rf`` of segments ``rs`` with their shot times ``tl``."""
    return f"""
rt AS (SELECT *, list_transform(list_filter(tl, lambda t: CAST(split_part(t, ':', 2) AS int) < 60), lambda t: greatest(least(s + CAST(split_part(t, ':', 1) AS int) * 60 + CAST(split_part(t, ':', 2) AS int), e), s)) AS ab FROM rs),
ru AS (SELECT *, CASE WHEN NOT threat THEN 'fallback_not_threat' WHEN NOT has_metrics THEN 'fallback_no_metrics' WHEN len(tl) = 0 THEN 'fallback_no_shots' WHEN len(ab) = 0 THEN 'fallback_unparseable' ELSE 'shot_timestamps' END AS src,
   greatest(s, list_min(ab) - {pre}) AS a, least(e, list_max(ab) + {post}) AS b FROM rt),
rv AS (SELECT *, {width} - (b - a) AS lack, CAST(floor(({width} - (b - a)) / 2) AS int) AS pb FROM ru),
rw AS (SELECT *, lack - pb AS pa, greatest(s, a - pb) AS na, least(e, b + lack - pb) AS nb FROM rv),
rx AS (SELECT *, CASE WHEN a - na < pb THEN least(e, nb + pb - (a - na)) ELSE nb END AS nb2, CASE WHEN nb - b < pa THEN greatest(s, na - (pa - (nb - b))) ELSE na END AS na2 FROM rw),
rf AS (SELECT seg_id, vid, threat, s AS start_s, e AS end_s, CAST(CASE WHEN src <> 'shot_timestamps' THEN s WHEN lack > 0 THEN na2 ELSE a END AS int) AS start_refined,
   CAST(CASE WHEN src <> 'shot_timestamps' THEN e WHEN lack > 0 THEN nb2 ELSE b END AS int) AS end_refined, src AS refinement_source FROM rx)"""


SQL_REFINE = SQL_REPLY + """,
rs AS (SELECT seg_id, vid, seg_id % 4 <> 3 AS threat, CAST(seg_id % 3000 AS int) AS s, CAST(seg_id % 3000 + 12 + seg_id % 40 AS int) AS e, seg_id % 10 <> 9 AS has_metrics,
   CASE WHEN seg_id % 10 = 9 THEN NULL WHEN seg_id % 10 = 8 THEN CAST([] AS varchar[]) ELSE list_transform(sl, lambda y: y.ts) END AS tl FROM rep),
""" + sql_refine(8, 8, 15)


def refined(spark, sf):
    """Segments with their decoded shot lists; some lack metrics or shots."""
    m = replies(spark, sf).select("seg_id", "vid", F.from_json(F.regexp_replace("raw", r"\}*( Hope .*)?$", "}}"), R.METRICS)["shot_timestamps"].alias("ts"))
    x = m.selectExpr(
        "seg_id", "vid", "seg_id % 4 <> 3 as threat", "cast(seg_id % 3000 as int) as start_s", "cast(seg_id % 3000 + 12 + seg_id % 40 as int) as end_s",
        "seg_id % 10 <> 9 as has_metrics", "case when seg_id % 10 = 9 then null when seg_id % 10 = 8 then slice(ts, 1, 0) else ts end as shot_timestamps",
    )
    return R.refine(x)


query("int13_refine", sql("", SQL_REFINE + " SELECT * FROM rf"))(lambda s, d: refined(s, d).drop("has_metrics", "shot_timestamps"))
query("int14_refine_summary", sql("", SQL_REFINE + """
SELECT vid, count(*) AS n_threats, count(*) FILTER (refinement_source = 'shot_timestamps') AS n_refined,
  round(avg(end_refined - start_refined - end_s + start_s) FILTER (refinement_source = 'shot_timestamps'), 6) AS avg_width_delta,
  min(end_refined - start_refined - end_s + start_s) FILTER (refinement_source = 'shot_timestamps') AS min_width_delta,
  max(end_refined - start_refined - end_s + start_s) FILTER (refinement_source = 'shot_timestamps') AS max_width_delta,
  median(end_s - start_s) AS orig_width_median, median(end_refined - start_refined) AS refined_width_median, median(end_s - start_s) - median(end_refined - start_refined) AS median_shrinkage
FROM rf WHERE threat GROUP BY vid"""))(
    lambda s, d: R.refine_summary(refined(s, d)).withColumn("avg_width_delta", F.round("avg_width_delta", 6))
)
query("int14_refine_sources", sql("", SQL_REFINE + " SELECT vid, refinement_source, count(*) AS n FROM rf GROUP BY 1, 2"))(
    lambda s, d: R.refine_sources(refined(s, d))
)

# -- logged goals ------------------------------------------------------------------------
SQL_REC = """
sg AS (SELECT vid, win_id AS seg_id, start_s, end_s, source <> 'faceoff' AS threat, win_id % 17 <> 5 AS has_metrics, CAST(CASE WHEN win_id % 11 = 0 THEN 1 ELSE 0 END AS int) AS goals FROM win),
lg AS (SELECT vid, idx AS goal_no, CASE WHEN idx % 13 = 0 THEN NULL ELSE start_s - 0.5::double END AS st, end_s + 0.25::double AS et FROM gt WHERE action = 'Goals'),
lt AS (SELECT * FROM lg WHERE st IS NOT NULL),
lo AS (SELECT l.vid, l.goal_no, l.st, l.et, row_number() OVER (PARTITION BY l.vid ORDER BY l.goal_no) AS rn FROM lt l),
lc AS (SELECT o.vid, o.rn, o.goal_no, list({'seg_id': s.seg_id, 'ov': least(o.et, s.end_s) - greatest(o.st, s.start_s)} ORDER BY s.seg_id) FILTER (s.seg_id IS NOT NULL) AS c
       FROM lo o LEFT JOIN sg s ON s.vid = o.vid AND s.threat AND s.has_metrics AND o.st <= s.end_s AND o.et >= s.start_s GROUP BY 1, 2, 3),
gw AS (SELECT DISTINCT vid, CAST(0 AS bigint) AS rn, CAST([] AS bigint[]) AS used, CAST(NULL AS bigint) AS goal_no, CAST(NULL AS bigint) AS seg_id FROM lc
  UNION ALL
  SELECT vid, rn, CASE WHEN b.seg_id >= 0 THEN list_append(used, b.seg_id) ELSE used END, goal_no, nullif(b.seg_id, -1) FROM (
    SELECT w.vid, l.rn, w.used, l.goal_no, list_reduce(list_concat([{'seg_id': CAST(-1 AS bigint), 'ov': CAST(-1 AS double)}], list_filter(coalesce(l.c, []), lambda x: NOT list_contains(w.used, x.seg_id))),
      lambda a, x: CASE WHEN a.seg_id = -1 OR x.ov > a.ov THEN x ELSE a END) AS b FROM gw w JOIN lc l ON l.vid = w.vid AND l.rn = w.rn + 1)),
cm AS (SELECT vid, goal_no, seg_id FROM gw WHERE rn > 0)"""


def rec_inputs(spark, sf):
    seg = V.win(spark, sf).selectExpr("vid", "win_id as seg_id", "start_s", "end_s", "source <> 'faceoff' as threat", "win_id % 17 <> 5 as has_metrics", "if(win_id % 11 = 0, 1, 0) as goals")
    goals = V.gt(spark, sf).filter("action = 'Goals'").selectExpr(
        "vid", "idx as goal_no", "if(idx % 13 = 0, null, start_s - 0.5D) as start_time", "end_s + 0.25D as end_time"
    )
    return seg, goals


query("jon13_reconcile_segments", sql("win gt games", SQL_REC + """
SELECT s.vid, s.seg_id, s.start_s, s.end_s, CASE WHEN c.seg_id IS NOT NULL THEN greatest(goals, 1) ELSE goals END AS goals, true AS was_ai_detected, c.seg_id IS NOT NULL AS manually_verified,
  s.vid IN (SELECT vid FROM lg) AND threat AND has_metrics AND goals > 0 AND c.seg_id IS NULL AS goal_unconfirmed, NULL AS threat_goalie_side, NULL AS metrics
FROM sg s LEFT JOIN cm c ON c.vid = s.vid AND c.seg_id = s.seg_id
UNION ALL SELECT c.vid, NULL, CAST(floor(st) AS int), CAST(ceil(et) AS int), 1, false, true, false, coalesce(m.target_side, 'unknown'),
  '{"shots":1,"shotsOnNet":1,"saves":0,"goals":1,"rebounds":0,"observed_goalie_side":"' || coalesce(m.target_side, 'unknown') || '","goal_criteria":{},"shot_timestamps":[]}'
FROM cm c JOIN lt USING (vid, goal_no) LEFT JOIN games m ON m.vid = c.vid WHERE c.seg_id IS NULL"""))(
    lambda s, d: R.reconcile(*rec_inputs(s, d), V.games(s, d).select("vid", F.col("target_side").alias("goalie_side")))[0].select(
        "vid", "seg_id", "start_s", "end_s", "goals", "was_ai_detected", "manually_verified", "goal_unconfirmed", "threat_goalie_side", F.to_json("metrics").alias("metrics")
    )
)
query("jon13_reconcile_goals", sql("win gt", SQL_REC + " SELECT l.vid, l.goal_no, c.seg_id IS NOT NULL AS was_ai_detected FROM lt l JOIN cm c USING (vid, goal_no) UNION ALL SELECT vid, goal_no, NULL FROM lg WHERE st IS NULL"))(
    lambda s, d: R.reconcile(*rec_inputs(s, d))[1].select("vid", "goal_no", "was_ai_detected")
)
query("snk11_injected_log", sql("win gt games", SQL_REC + """
SELECT c.vid || '_' || CAST(floor(st) AS int) || '_' || CAST(ceil(et) AS int) AS clip_id, g.opponent_team, 'ai_missed_goal_injected' AS action FROM cm c JOIN lt USING (vid, goal_no) LEFT JOIN games g ON g.vid = c.vid WHERE c.seg_id IS NULL"""))(
    lambda s, d: injected(s, d).select("clip_id", "context.opponent_team", F.col("user_validation.action_taken").alias("action"))
)


def injected(spark, sf):
    from ..sources.sinks import injected_log

    return injected_log(R.reconcile(*rec_inputs(spark, sf))[0], V.games(spark, sf))


# -- feedback replies -----------------------------------------------------------------------
DEPTHS = "array('Base (B)', ' base ', 'A', 'The goalie stays conservative then aggressive (A)', 'deep', 'DEFENSIVE', 'c', 'plays base depth')"
QUALS = "array('Good', 'excellent', 'AVERAGE ', 'a poor angle but good recovery', '', 'Poor', 'fair')"
REBS = "array('Killed (Elite)', 'elite', 'n/a', 'none', 'Goal Allowed', 'puck was steered to low-danger zone late', 'uncontrolled into high-danger zone', 'No shot', 'xx')"
CONFS = "array('3', '7', '85', '100', '0', 'true', '\"9\"', '\"bad\"', '11', '101')"


def feedback(spark, sf):
    """Raw feedback replies built from orders; every ninth one is cut short."""
    o = V.table(spark, sf, "orders").selectExpr(
        "o_orderkey as k",
        f"element_at({DEPTHS}, cast(o_orderkey % 8 + 1 as int)) as d", f"element_at({QUALS}, cast(o_orderkey div 3 % 7 + 1 as int)) as a",
        f"element_at({QUALS}, cast(o_orderkey div 5 % 7 + 1 as int)) as q", f"element_at({REBS}, cast(o_orderkey div 7 % 9 + 1 as int)) as r",
        f"element_at({CONFS}, cast(o_orderkey % 10 + 1 as int)) as c1", f"element_at({CONFS}, cast(o_orderkey div 2 % 10 + 1 as int)) as c2",
    )
    text = F.expr(
        """concat('{"technical_reasoning":"saw it","goalie_positioning":{"depth_rank":"', d, '","cover_angle_rank":"', a, '","squareness_rank":"', q,
        '","goalie_position_confidence_score":', c1, '},"coaching_feedback":{"rebound_control_rank":"', r, '","coaching_confidence_score":', c2, '}}')"""
    )
    # the table is one file, so one task: spread the text work first
    o = o.repartition(spark.sparkContext.defaultParallelism)
    return o.withColumn("t", text).selectExpr("k", "if(k % 9 = 0, substr(t, 1, length(t) - 2), t) as raw")


def _arr(expr):
    return "[" + expr[len("array(") : -1].replace("\\\"", '"').replace('\'\\"', "'\"") + "]"


def sql_enum(c, kind):
    al = L.aliases(kind)
    direct = " ".join(f"WHEN lower(trim({c})) = '{a}' THEN '{lab}'" for a, lab in al.items())
    import re

    items = ", ".join(
        "{'p': CASE WHEN regexp_matches(lower(" + c + "), '\\b" + re.escape(a) + "\\b') THEN length(regexp_extract(lower(" + c + "), '^((?s:.)*?)\\b" + re.escape(a) + "\\b', 1)) ELSE 99999 END, 'l': " + str(-len(a)) + ", 'v': '" + lab + "'}"
        for a, lab in al.items() if len(a) >= 2
    )
    return f"CASE {direct} ELSE CASE WHEN length({c}) >= 3 THEN (SELECT CASE WHEN min(u.p) < 99999 THEN arg_min(u.v, u.p * 1000 + u.l) END FROM (SELECT unnest([{items}]) AS u)) END END"


def sql_conf(c):
    n = f"TRY_CAST(trim({c}, '\"') AS int)"
    return f"CASE WHEN {n} BETWEEN 1 AND 5 THEN {n} WHEN {n} BETWEEN 6 AND 10 THEN ({n} + 1) // 2 WHEN {n} BETWEEN 11 AND 100 THEN least(greatest(({n} + 10) // 20, 1), 5) END"


SQL_FB = f"""
fb0 AS (SELECT o_orderkey AS k, ({_arr(DEPTHS)})[o_orderkey % 8 + 1] AS d, ({_arr(QUALS)})[o_orderkey // 3 % 7 + 1] AS a, ({_arr(QUALS)})[o_orderkey // 5 % 7 + 1] AS q,
   ({_arr(REBS)})[o_orderkey // 7 % 9 + 1] AS r, ({_arr(CONFS)})[o_orderkey % 10 + 1] AS c1, ({_arr(CONFS)})[o_orderkey // 2 % 10 + 1] AS c2, o_orderkey % 9 = 0 AS bad FROM orders),
td AS (SELECT d, {sql_enum('d', 'depth')} AS v FROM (SELECT DISTINCT d FROM fb0)), tq AS (SELECT a, {sql_enum('a', 'quality')} AS v FROM (SELECT DISTINCT a FROM fb0)),
tr AS (SELECT r, {sql_enum('r', 'rebound')} AS v FROM (SELECT DISTINCT r FROM fb0)),
fb1 AS (SELECT k, bad, CASE WHEN NOT bad THEN td.v END AS depth_rank, CASE WHEN NOT bad THEN x.v END AS cover_angle_rank, CASE WHEN NOT bad THEN y.v END AS squareness_rank, CASE WHEN NOT bad THEN tr.v END AS rebound_control_rank,
   CASE WHEN NOT bad THEN {sql_conf('c1')} END AS position_confidence, CASE WHEN NOT bad THEN {sql_conf('c2')} END AS coaching_confidence
  FROM fb0 JOIN td USING (d) JOIN tq x ON x.a = fb0.a JOIN tq y ON y.a = fb0.q JOIN tr USING (r)),
fb2 AS (SELECT *, CASE WHEN bad THEN ['unparseable'] ELSE list_filter([CASE WHEN depth_rank IS NULL THEN 'depth_rank' END, CASE WHEN cover_angle_rank IS NULL THEN 'cover_angle_rank' END, CASE WHEN squareness_rank IS NULL THEN 'squareness_rank' END,
   CASE WHEN rebound_control_rank IS NULL THEN 'rebound_control_rank' END, CASE WHEN position_confidence IS NULL THEN 'position_confidence' END, CASE WHEN coaching_confidence IS NULL THEN 'coaching_confidence' END], lambda e: e IS NOT NULL) END AS errors FROM fb1)"""


def validated(spark, sf):
    return R.validate_clip(feedback(spark, sf))


query("cln2_valid_clips", sql("", SQL_FB + " SELECT k, depth_rank, cover_angle_rank, squareness_rank, rebound_control_rank, position_confidence, coaching_confidence FROM fb2 WHERE len(errors) = 0"))(
    lambda s, d: R.valid_clips(validated(s, d)).drop("caveats")
)
query("cln2_rejected_clips", sql("", SQL_FB + " SELECT k, array_to_string(errors, ',') AS errors FROM fb2 WHERE len(errors) > 0"))(
    lambda s, d: R.rejected_clips(validated(s, d)).select("k", F.array_join("errors", ",").alias("errors"))
)
query("cln2_reject_reasons", sql("", SQL_FB + " SELECT reason, count(*) AS n FROM (SELECT unnest(errors) AS reason FROM fb2) GROUP BY 1"))(
    lambda s, d: R.reject_reasons(validated(s, d))
)
query("sca12_clip_record", sql("clips", """
SELECT clip_no, vid || '_' || start_s || '_' || end_s AS clip_id, end_s - start_s AS clip_duration, shots > 0 AS clip_shot, shots AS clip_shot_count, saves > 0 AS clip_save, saves AS clip_save_count, goals > 0 AS clip_has_goal FROM clips"""))(
    lambda s, d: R.clip_record(V.clips(s, d)).select("clip_no", "clip_id", "clip_duration", "clip_shot", "clip_shot_count", "clip_save", "clip_save_count", "clip_has_goal")
)
SQL_FBV = SQL_FB + ", fv AS (SELECT *, k % 50 AS vid FROM fb2)"
query("agg30_rating", sql("", SQL_FBV + """,
g AS (SELECT vid, avg(CASE WHEN depth_rank IN ('Aggressive (A)','Base (B)') THEN 1.0 ELSE 0 END) AS d, avg(CASE WHEN cover_angle_rank IN ('Excellent','Good') THEN 1.0 ELSE 0 END) AS a, avg(CASE WHEN squareness_rank IN ('Excellent','Good') THEN 1.0 ELSE 0 END) AS q,
  avg(CASE WHEN rebound_control_rank IN ('Killed (Elite)','Steered to Low-Danger Zone') THEN 1.0 ELSE 0 END) AS r, count(*) FILTER (rebound_control_rank = 'Goal Allowed') AS ga, avg(CASE WHEN cover_angle_rank = 'Poor' THEN 1.0 ELSE 0 END) AS pa,
  avg(CASE WHEN squareness_rank = 'Poor' THEN 1.0 ELSE 0 END) AS pq FROM fv WHERE len(errors) = 0 GROUP BY vid)
SELECT vid, CAST(greatest(least(60 + CASE WHEN d >= 0.6 THEN 10 ELSE 0 END + CASE WHEN a >= 0.6 THEN 10 ELSE 0 END + CASE WHEN q >= 0.6 THEN 10 ELSE 0 END + CASE WHEN r >= 0.6 THEN 5 ELSE 0 END - 5 * ga - CASE WHEN pa >= 0.3 OR pq >= 0.3 THEN 5 ELSE 0 END, 100), 0) AS varchar) || '%' AS rating FROM g"""))(
    lambda s, d: R.rating(R.valid_clips(validated(s, d)).withColumn("vid", F.expr("k % 50")))
)
query("agg29_game_summary", sql("", SQL_FBV + "SELECT vid, count(*) AS windows_analysed, count(*) FILTER (len(errors) = 0) AS windows_succeeded, count(*) FILTER (len(errors) > 0) AS windows_failed FROM fv GROUP BY vid"))(
    lambda s, d: R.game_summary(validated(s, d).selectExpr("k % 50 as vid", "k as start_s", "if(size(errors) > 0, array_join(errors, ','), null) as error"))
)
