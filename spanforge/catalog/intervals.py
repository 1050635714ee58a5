"""Interval queries: merge, split, confirm, trim, filter and trace."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import views as V
from ..functions.spans import iou, midpoint
from ..operators import intervals as I, series as S
from ..views import BLK, sql
from .registry import query
from .series import SQL_FUSE, SQL_ONE, fused, one, peaks, r6
from .series import SQL_NMS

SQL_WINDOWS = SQL_NMS + """,
wl AS (SELECT vid, max(t) AS max_t FROM fused GROUP BY vid),
sp AS (SELECT vid, greatest(t - 8, 0) AS s, least(t + 4, max_t) AS e FROM nms JOIN wl USING (vid)),
so AS (SELECT *, max(e) OVER (PARTITION BY vid ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM sp),
si AS (SELECT *, sum(CASE WHEN pe IS NULL OR s > pe THEN 1 ELSE 0 END) OVER (PARTITION BY vid ORDER BY s, e) AS isl FROM so),
pred AS (SELECT vid, min(s) AS start_s, max(e) AS end_s FROM si GROUP BY vid, isl)"""


def pred(spark, sf):
    """Predicted windows: peaks expanded by 8 s before and 4 s after."""
    length = fused(spark, sf).groupBy("vid").agg(F.max("t").alias("max_t"))
    return I.expand_merge(peaks(spark, sf), length, 8, 4)


query("int1_expand_merge", sql("probs", SQL_WINDOWS + " SELECT vid, start_s, end_s FROM pred"))(pred)

query("int2_merge_overlap", sql("probs", SQL_ONE + """,
w AS (SELECT vid, greatest(t - 1, 0) AS s, t + 1 AS e, p FROM one WHERE p >= 0.5),
o AS (SELECT *, max(e) OVER (PARTITION BY vid ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM w),
i AS (SELECT *, sum(CASE WHEN pe IS NULL OR s > pe THEN 1 ELSE 0 END) OVER (PARTITION BY vid ORDER BY s, e) AS isl FROM o)
SELECT vid, min(s) AS start_s, max(e) AS end_s, max(p) AS confidence FROM i GROUP BY vid, isl"""))(
    lambda s, d: I.merge_overlap(
        one(s, d).filter("p >= 0.5").selectExpr("vid", "greatest(t - 1, 0) as start_s", "t + 1 as end_s", "p as confidence")
    )
)

SQL_GTM = """
gr AS (SELECT * FROM gt WHERE action IN ('Shots','Goals')),
gf AS (SELECT vid, team, min(idx) AS team_first FROM gr GROUP BY 1, 2),
go AS (SELECT *, max(end_s) OVER (PARTITION BY vid, team ORDER BY start_s, idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM gr),
gi AS (SELECT *, sum(CASE WHEN pe IS NULL OR start_s - pe >= {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY vid, team ORDER BY start_s, idx) AS isl FROM go),
gm AS (SELECT vid, team, min(start_s) AS start_s, max(end_s) AS end_s, arg_min(half, idx) AS period FROM gi GROUP BY vid, team, isl),
gtm AS (SELECT vid, CAST(row_number() OVER (PARTITION BY vid ORDER BY start_s, team_first) - 1 AS int) AS gt_id, start_s, end_s, team, period
        FROM gm JOIN gf USING (vid, team))"""
GT_GAP = 2
SQL_GT = SQL_GTM.format(gap=GT_GAP).replace("arg_min(half, idx)", "arg_min(half, start_s * 1000000 + idx)")


def gtm(spark, sf):
    return I.merge_events(V.gt(spark, sf), GT_GAP)


query("int3_merge_events", sql("gt", SQL_GT + " SELECT * FROM gtm"))(gtm)
query("int4_pad", sql("gt", SQL_GT + " SELECT vid, gt_id, greatest(start_s - 2, 0) AS start_s, end_s + 2 AS end_s FROM gtm"))(
    lambda s, d: I.pad(gtm(s, d), 2).select("vid", "gt_id", "start_s", "end_s")
)

SQL_CLASS = """
cs AS (SELECT vid, start_s, end_s, color, win_id AS ord, row_number() OVER (PARTITION BY vid ORDER BY start_s, end_s, win_id) AS rn
       FROM win),
mc AS (
  SELECT vid, CAST(0 AS bigint) AS rn, CAST([] AS struct(s int, e int, th boolean, c varchar)[]) AS done,
         CAST(NULL AS struct(s int, e int, th boolean, c varchar)) AS cur FROM (SELECT DISTINCT vid FROM cs)
  UNION ALL
  SELECT m.vid, x.rn,
    CASE WHEN m.cur IS NULL THEN m.done
         WHEN x.start_s > m.cur.e THEN list_concat(m.done, [m.cur, {'s': m.cur.e, 'e': x.start_s, 'th': false, 'c': CAST(NULL AS varchar)}])
         WHEN x.start_s = m.cur.e THEN list_append(m.done, m.cur)
         WHEN m.cur.c = x.color THEN m.done
         WHEN x.start_s > m.cur.s THEN list_append(m.done, {'s': m.cur.s, 'e': x.start_s, 'th': m.cur.th, 'c': m.cur.c})
         ELSE m.done END,
    CASE WHEN m.cur IS NOT NULL AND x.start_s < m.cur.e AND m.cur.c = x.color
         THEN {'s': m.cur.s, 'e': greatest(m.cur.e, x.end_s), 'th': true, 'c': m.cur.c}
         ELSE {'s': x.start_s, 'e': x.end_s, 'th': true, 'c': x.color} END
  FROM mc m JOIN cs x ON x.vid = m.vid AND x.rn = m.rn + 1),
ml AS (SELECT vid, arg_max(list_append(done, cur), rn) AS segs FROM mc GROUP BY vid),
mcl AS (SELECT vid, u.s AS start_s, u.e AS end_s, u.th AS threat, u.c AS color FROM (SELECT vid, unnest(segs) AS u FROM ml))"""


def classified(spark, sf):
    """All raw windows as classified threats."""
    return V.win(spark, sf).selectExpr("vid", "start_s", "end_s", "true as threat", "color", "win_id as ord")


def merged(spark, sf):
    return I.merge_classified(classified(spark, sf))


query("int5_merge_classified", sql("win", SQL_CLASS + " SELECT * FROM mcl"))(merged)

SQL_DUR = "lengths AS (SELECT vid, max(t) - 5 AS dur FROM ev GROUP BY vid)"


def lengths(spark, sf):
    return V.ev(spark, sf).groupBy("vid").agg((F.max("t") - 5).alias("dur"))


SQL_COVER_RAW = SQL_DUR + """,
raw AS (SELECT vid, start_s + 4 AS start_s, end_s + 4 AS end_s, true AS threat, color, win_id AS ord FROM win),
k AS (SELECT vid, start_s AS raw_s, greatest(least(start_s, dur), 0) AS s, greatest(least(end_s, dur), 0) AS e, color, ord, dur FROM raw JOIN lengths USING (vid)),
kk AS (SELECT *, lag(e) OVER (PARTITION BY vid ORDER BY raw_s, ord) AS pe, row_number() OVER (PARTITION BY vid ORDER BY raw_s, ord) AS rn FROM k WHERE e > s),
first_s AS (SELECT vid, min(start_s) AS a FROM raw GROUP BY vid),
st AS (SELECT l.vid, dur, a, f.s AS first, z.e AS last FROM lengths l LEFT JOIN first_s USING (vid)
       LEFT JOIN (SELECT vid, min(s) AS s FROM kk GROUP BY vid) f USING (vid)
       LEFT JOIN (SELECT vid, arg_max(e, rn) AS e FROM kk GROUP BY vid) z USING (vid)),
cov AS (
  SELECT vid, s AS start_s, e AS end_s, true AS threat, color FROM kk
  UNION ALL SELECT vid, pe, s, false, NULL FROM kk WHERE pe < s
  UNION ALL SELECT vid, 0, CASE WHEN first IS NULL THEN dur ELSE a END, false, NULL FROM st WHERE a IS NULL OR a > 0
  UNION ALL SELECT vid, a, first, false, NULL FROM st WHERE a > 0 AND a < first
  UNION ALL SELECT vid, last, dur, false, NULL FROM st WHERE last < dur)"""
query("int6_cover", sql("ev win", SQL_COVER_RAW + " SELECT * FROM cov"))(
    lambda s, d: I.cover(
        # 4 s later, so that there is a gap in front
        V.win(s, d).selectExpr("vid", "start_s + 4 as start_s", "end_s + 4 as end_s", "true as threat", "color", "win_id as ord"),
        lengths(s, d),
        BLK,
    )
)

SQL_ADJ = """
{src}o AS (SELECT *, row_number() OVER (PARTITION BY vid ORDER BY start_s, end_s) AS rn FROM {src}),
{src}w AS (
  SELECT vid, CAST(0 AS bigint) AS rn, CAST([] AS struct(s int, e int, th boolean, c varchar)[]) AS done,
         CAST(NULL AS struct(s int, e int, th boolean, c varchar)) AS cur FROM (SELECT DISTINCT vid FROM {src})
  UNION ALL
  SELECT m.vid, x.rn,
    CASE WHEN m.cur IS NULL THEN m.done
         WHEN m.cur.th = x.threat AND m.cur.c IS NOT DISTINCT FROM x.color AND NOT (x.threat AND x.end_s - m.cur.s > {cap}) THEN m.done
         ELSE list_append(m.done, m.cur) END,
    CASE WHEN m.cur IS NOT NULL AND m.cur.th = x.threat AND m.cur.c IS NOT DISTINCT FROM x.color AND NOT (x.threat AND x.end_s - m.cur.s > {cap})
         THEN {{'s': m.cur.s, 'e': greatest(m.cur.e, x.end_s), 'th': x.threat, 'c': x.color}}
         ELSE {{'s': x.start_s, 'e': x.end_s, 'th': x.threat, 'c': x.color}} END
  FROM {src}w m JOIN {src}o x ON x.vid = m.vid AND x.rn = m.rn + 1),
{out} AS (SELECT vid, u.s AS start_s, u.e AS end_s, u.th AS threat, u.c AS color FROM (
  SELECT vid, unnest(segs) AS u FROM (SELECT vid, arg_max(list_append(done, cur), rn) AS segs FROM {src}w GROUP BY vid)))"""
SQL_ADJ1 = SQL_CLASS + "," + SQL_ADJ.format(src="mcl", out="adj", cap=20)


def adjacent(spark, sf):
    return I.merge_adjacent(merged(spark, sf), 20)


query("int7_merge_adjacent", sql("win", SQL_ADJ1 + " SELECT * FROM adj"))(adjacent)
SQL_SPLIT = SQL_ADJ1 + """,
spl AS (SELECT vid, s AS start_s, CASE WHEN long THEN least(s + 6, end_s) ELSE end_s END AS end_s, threat, color FROM (
  SELECT *, threat AND end_s - start_s > 6 AS long, unnest(CASE WHEN threat AND end_s - start_s > 6 THEN CAST(range(start_s, end_s, 6) AS int[]) ELSE [start_s] END) AS s FROM adj))"""


def split(spark, sf):
    return I.split_long(adjacent(spark, sf), 6)


query("int8_split_long", sql("win", SQL_SPLIT + " SELECT * FROM spl"))(split)


def periods(spark, sf):
    return V.games(spark, sf).select("vid", F.explode("periods").alias("p")).select(
        "vid", "p.num", F.col("p.start").alias("p_start"), F.col("p.end").alias("p_end")
    )


query("int9_split_periods", sql("win games periods", SQL_CLASS + """
SELECT m.vid, greatest(start_s, p_start) AS start_s, least(end_s, p_end) AS end_s, threat, color
FROM mcl m JOIN periods p ON p.vid = m.vid AND m.end_s > p_start AND m.start_s < p_end WHERE m.end_s > m.start_s
UNION ALL SELECT vid, start_s, end_s, threat, color FROM mcl WHERE vid NOT IN (SELECT vid FROM periods)"""))(
    lambda s, d: I.split_periods(merged(s, d), periods(s, d), BLK)
)
query("int10_cap_split", sql("win", """
b AS (SELECT vid, win_id, start_s, start_s + (end_s - start_s) * 20 AS end_s, true AS threat, 1.0 + (win_id % 4) * 0.05 AS motion_ratio FROM win),
f AS (SELECT *, end_s - start_s > 100 AND motion_ratio < 1.1 AS sp FROM b),
k AS (SELECT *, unnest(CASE WHEN sp THEN range(0, CAST(greatest(ceil((end_s - start_s - 90) / 75.0), 0) AS int) + 1) ELSE [0] END) AS i FROM f)
SELECT vid, win_id, CAST(start_s + i * 75 AS int) AS start_s, CAST(CASE WHEN sp THEN least(start_s + i * 75 + 90, end_s) ELSE end_s END AS int) AS end_s,
       CASE WHEN sp THEN start_s || '-' || end_s END AS capped_parent, CASE WHEN sp THEN CAST(i AS int) END AS capped_index FROM k"""))(
    lambda s, d: I.cap_split(
        V.win(s, d).selectExpr(
            "vid", "win_id", "start_s", "start_s + (end_s - start_s) * 20 as end_s", "true as threat",
            "cast(1.0 + (win_id % 4) * 0.05 as double) as motion_ratio",
        )
    ).select("vid", "win_id", "start_s", "end_s", "capped_parent", "capped_index")
)

SQL_CONFIRM = """
oth AS (SELECT vid, start_s AS os, end_s AS oe FROM win WHERE source <> 'motion_auto_close'
        UNION ALL SELECT vid, CAST(floor(t) AS int), CAST(floor(t) AS int) + 6 FROM whistles),
conf AS (SELECT * FROM win w WHERE source <> 'motion_auto_close' OR EXISTS (
  SELECT 1 FROM oth o WHERE o.vid = w.vid AND least(w.end_s, oe) - greatest(w.start_s, os) >= 6))"""


def confirmed(spark, sf):
    return I.confirm(V.win(spark, sf), V.whistles(spark, sf), 6, 6, block=BLK)


query("int11_confirm", sql("win whistles", SQL_CONFIRM + " SELECT vid, win_id, start_s, end_s, source, color FROM conf"))(
    lambda s, d: confirmed(s, d).select("vid", "win_id", "start_s", "end_s", "source", "color")
)
query("int12_trim_at_event", sql("win whistles", """
f AS (SELECT w.vid, w.win_id, w.start_s, w.end_s, (SELECT min(t) FROM whistles h WHERE h.vid = w.vid AND h.t > w.start_s AND h.t < w.end_s) AS wt FROM win w)
SELECT vid, win_id, start_s, CASE WHEN wt IS NOT NULL THEN least(end_s, CAST(floor(wt) AS int) + 2) ELSE end_s END AS end_s FROM f"""))(
    lambda s, d: I.trim_at_event(V.win(s, d), V.whistles(s, d), 2).select("vid", "win_id", "start_s", "end_s")
)
query("int15_threat_seconds", sql("win", SQL_CLASS + """
SELECT vid, CAST(sum(end_s - start_s) AS bigint) AS threat_seconds FROM mcl WHERE threat AND end_s > start_s GROUP BY vid"""))(
    lambda s, d: I.threat_seconds(merged(s, d))
)
SQL_TRACE = SQL_WINDOWS + """,
tr AS (SELECT p.vid, p.start_s, p.end_s, list_sort(coalesce(list(DISTINCT w.source) FILTER (w.source IS NOT NULL), [])) AS source_signals, count(w.win_id) AS n_overlapping_raw
  FROM pred p LEFT JOIN win w ON w.vid = p.vid AND w.end_s > p.start_s AND w.start_s < p.end_s GROUP BY 1, 2, 3)"""


def traced(spark, sf):
    return I.source_trace(pred(spark, sf), V.win(spark, sf), BLK)


query("int16_source_trace", sql("probs win", SQL_TRACE + " SELECT vid, start_s, end_s, array_to_string(source_signals, '+') AS combo, n_overlapping_raw FROM tr"))(
    lambda s, d: traced(s, d).select("vid", "start_s", "end_s", F.array_join("source_signals", "+").alias("combo"), "n_overlapping_raw")
)
query("int18_iou", sql("win", """
o AS (SELECT *, lead(start_s) OVER w AS s2, lead(end_s) OVER w AS e2 FROM win WINDOW w AS (PARTITION BY vid, start_s // 24 ORDER BY start_s, win_id))
SELECT vid, win_id, round(coalesce(greatest(least(end_s, e2) - greatest(start_s, s2), 0) / nullif((end_s - start_s) + (e2 - s2) - greatest(least(end_s, e2) - greatest(start_s, s2), 0), 0), 0), 6) AS iou,
       0.5::double * (start_s + end_s) AS mid FROM o WHERE s2 IS NOT NULL"""))(
    lambda s, d: V.win(s, d)
    .selectExpr(
        "vid", "win_id", "start_s", "end_s",
        "lead(start_s) over (partition by vid, start_s div 24 order by start_s, win_id) as s2",
        "lead(end_s) over (partition by vid, start_s div 24 order by start_s, win_id) as e2",
    )
    .filter("s2 is not null")
    .select("vid", "win_id", F.round(iou(F.col("start_s"), F.col("end_s"), F.col("s2"), F.col("e2")), 6).alias("iou"),
            midpoint(F.col("start_s"), F.col("end_s")).alias("mid"))
)
query("int19_midpoint", sql("gt", SQL_GT + " SELECT vid, gt_id, 0.5::double * (start_s + end_s) AS mid FROM gtm"))(
    lambda s, d: gtm(s, d).select("vid", "gt_id", midpoint(F.col("start_s"), F.col("end_s")).alias("mid"))
)

# -- filters -----------------------------------------------------------------
query("flt1_threat_windows", sql("win", SQL_CLASS + " SELECT vid, start_s, end_s, color FROM mcl WHERE threat"))(
    lambda s, d: I.threat_windows(merged(s, d))
)
query("flt2_min_duration", sql("win", "SELECT vid, win_id, start_s, end_s FROM win WHERE end_s - start_s + 1 >= 6"))(
    lambda s, d: I.min_duration(V.win(s, d), 6, inclusive=True).select("vid", "win_id", "start_s", "end_s")
)
query("flt3_drop_opening_fp", sql("win sig", """
SELECT vid, win_id, start_s, end_s FROM win w WHERE end_s > 20 OR EXISTS (
  SELECT 1 FROM sig s WHERE s.vid = w.vid AND s.faceoff >= 0.8 AND s.t BETWEEN w.start_s AND w.end_s)"""))(
    lambda s, d: I.drop_opening_fp(V.win(s, d), V.sig(s, d).filter("faceoff >= 0.8").select("vid", "t")).select("vid", "win_id", "start_s", "end_s")
)
query("flt4_demote_short", sql("win", SQL_CLASS + """
SELECT vid, start_s, end_s, threat AND end_s - start_s >= 5 AS threat, CASE WHEN threat AND end_s - start_s >= 5 THEN color END AS color FROM mcl"""))(
    lambda s, d: I.demote_short(merged(s, d), 5)
)
query("flt5_target_filter", sql("win games", SQL_CLASS + """
SELECT vid, count(*) AS total, count(*) FILTER (threat) AS threats, count(*) FILTER (threat AND color = target_color) AS target,
       count(*) FILTER (threat) - count(*) FILTER (threat AND color = target_color) AS opponent, count(*) - count(*) FILTER (threat) AS no_threat
FROM mcl JOIN games USING (vid) GROUP BY vid"""))(lambda s, d: I.target_filter_counts(merged(s, d), V.games(s, d)))
query("flt5_target_segments", sql("win games", SQL_CLASS + """
SELECT vid, start_s, end_s, threat, color FROM mcl JOIN games USING (vid) WHERE threat AND color = target_color"""))(
    lambda s, d: I.target_filter(merged(s, d), V.games(s, d))
)
query("flt6_gate_windows", sql("probs win", SQL_FUSE + """,
pk AS (SELECT w.win_id, max(p) AS peak FROM win w JOIN fused f ON f.vid = w.vid AND f.t BETWEEN w.start_s AND w.end_s GROUP BY 1)
SELECT vid, win_id, round(CASE WHEN vid NOT IN (SELECT vid FROM fused) THEN 1.0 ELSE coalesce(peak, 0) END, 6) AS peak,
       CASE WHEN vid NOT IN (SELECT vid FROM fused) THEN 1.0 ELSE coalesce(peak, 0) END < 0.2 AS skip FROM win LEFT JOIN pk USING (win_id)"""))(
    lambda s, d: r6(I.gate_windows(V.win(s, d), fused(s, d), 0.2, BLK).select("vid", "win_id", "peak", "skip"), "peak")
)
query("flt9_hybrid", sql("probs win", SQL_WINDOWS + """,
rich AS (SELECT vid FROM pred GROUP BY vid HAVING count(*) >= 30)
SELECT vid, start_s, end_s, 'primary' AS method FROM pred WHERE vid IN (SELECT vid FROM rich)
UNION ALL SELECT vid, start_s, end_s, 'fallback' FROM win WHERE vid NOT IN (SELECT vid FROM rich)"""))(
    lambda s, d: I.hybrid(pred(s, d), V.win(s, d).select("vid", "start_s", "end_s"), 30)
)
query("flt12_duplicate_ids", sql("", "SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1 HAVING count(*) > 1"))(
    lambda s, d: duplicate_keys(V.table(s, d, "conversations"), "conv_id")
)


def duplicate_keys(df, key):
    return df.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")


query("set3_union_sources", sql("sig win", """
e AS (SELECT vid, max(t) + 1 AS dur FROM sig GROUP BY vid)
SELECT vid, start_s, end_s, source, color FROM win
UNION ALL SELECT vid, CAST(greatest(t - 25, 0) AS int), CAST(least(t + 15, dur) AS int), 'faceoff', NULL FROM sig JOIN e USING (vid) WHERE faceoff >= 0.8"""))(
    lambda s, d: V.win(s, d).select("vid", "start_s", "end_s", "source", "color").unionByName(
        S.trigger_windows(V.sig(s, d), "faceoff", 0.8, 25, 15, "faceoff").drop("t"), allowMissingColumns=True
    )
)
