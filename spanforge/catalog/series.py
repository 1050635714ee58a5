"""Series queries: densify, fuse, smooth, peaks, runs, bursts, sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import views as V
from ..operators import series as S
from ..views import BLK, sql
from .registry import query

WEIGHTS = {"a": 0.5, "b": 0.5}

# dense grid of one channel-free series: the fused score
SQL_FUSE = """
len_c AS (SELECT vid, channel, max(t) + 1 AS n FROM probs GROUP BY 1, 2),
len_v AS (SELECT vid, min(n) AS n, sum(0.5) AS w FROM len_c GROUP BY 1),
grid AS (SELECT vid, w, CAST(unnest(range(n)) AS int) AS t FROM len_v),
fused AS (
  SELECT g.vid, g.t, (CAST(0.5 AS double) / g.w) * coalesce(a.p, 0) + (CAST(0.5 AS double) / g.w) * coalesce(b.p, 0) AS p
  FROM grid g LEFT JOIN probs a ON a.vid = g.vid AND a.t = g.t AND a.channel = 'a'
              LEFT JOIN probs b ON b.vid = g.vid AND b.t = g.t AND b.channel = 'b')"""
SQL_SMOOTH = SQL_FUSE + """,
sm AS (SELECT vid, t, (coalesce(lag(p) OVER w, p) + p + coalesce(lead(p) OVER w, p)) / 3 AS p
       FROM fused WINDOW w AS (PARTITION BY vid ORDER BY t))"""
SQL_MAXIMA = SQL_SMOOTH + """,
pk AS (SELECT vid, t, p FROM (SELECT *, coalesce(lag(p) OVER w, -1) AS l, coalesce(lead(p) OVER w, -1) AS r
       FROM sm WINDOW w AS (PARTITION BY vid ORDER BY t)) WHERE p >= 0.1 AND p >= l AND p > r)"""
SQL_NMS = SQL_MAXIMA + """,
ranked AS (SELECT *, row_number() OVER (PARTITION BY vid ORDER BY p DESC, t DESC) AS rn FROM pk),
walk AS (
  SELECT DISTINCT vid, CAST(0 AS bigint) AS rn, CAST([] AS int[]) AS kept FROM ranked
  UNION ALL
  SELECT w.vid, r.rn, CASE WHEN len(list_filter(w.kept, lambda k: abs(k - r.t) <= 8)) > 0 THEN w.kept
                           ELSE list_append(w.kept, r.t) END
  FROM walk w JOIN ranked r ON r.vid = w.vid AND r.rn = w.rn + 1),
kept_t AS (SELECT vid, unnest(kept) AS t FROM (SELECT vid, arg_max(kept, rn) AS kept FROM walk GROUP BY vid)),
nms AS (SELECT k.vid, k.t, p.p FROM kept_t k JOIN pk p USING (vid, t))"""
SQL_CAND = SQL_NMS + """,
cand AS (SELECT vid, CAST(row_number() OVER (PARTITION BY vid ORDER BY p DESC, t) AS int) AS rank,
       CAST(t AS double) AS t_seconds, lpad(CAST(t // 60 AS varchar), 2, '0') || ':' || lpad(CAST(t % 60 AS varchar), 2, '0') AS t_mmss,
       CAST(round_even(CAST(CAST(p AS varchar) AS decimal(38,20)), 4) AS double) AS confidence FROM nms)"""

#: one score per (vid, t): the larger channel, not densified
SQL_ONE = "one AS (SELECT vid, t, max(p) AS p FROM probs GROUP BY 1, 2)"


def r6(df, *cols):
    for c in cols:
        df = df.withColumn(c, F.round(c, 6))
    return df


def fused(spark, sf):
    return S.fuse(V.probs(spark, sf), WEIGHTS, BLK)


def one(spark, sf):
    return V.probs(spark, sf).groupBy("vid", "t").agg(F.max("p").alias("p"))


def peaks(spark, sf):
    return S.find_peaks(fused(spark, sf), 3, 0.1, 8, block=BLK)


def cands(spark, sf):
    return S.candidates(V.probs(spark, sf), WEIGHTS, 0.1, 8, 3, block=BLK)


query("src2_densify", sql("probs", """
n AS (SELECT vid, channel, max(t) AS m FROM probs GROUP BY 1, 2),
g AS (SELECT vid, channel, CAST(unnest(range(m + 1)) AS int) AS t FROM n)
SELECT g.vid, g.channel, g.t, coalesce(p, 0.0) AS p FROM g LEFT JOIN probs USING (vid, channel, t)"""))(
    lambda s, d: S.densify(
        V.ev(s, d)
        .withColumn("channel", F.when(F.col("event_type").isin("purchase", "signup"), "b").otherwise("a"))
        .withColumn("p", F.least(F.col("value") / 100, F.lit(1.0))),
        "p", ("vid", "channel"), order="event_id",
    )
)

query("ser1_fuse", sql("probs", SQL_FUSE + "SELECT vid, t, round(p, 6) AS p FROM fused"))(
    lambda s, d: r6(fused(s, d), "p")
)
query("ser2_smooth", sql("probs", SQL_SMOOTH + "SELECT vid, t, round(p, 6) AS p FROM sm"))(
    lambda s, d: r6(S.smooth(fused(s, d), 3, block=BLK), "p")
)
query("ser3_local_maxima", sql("probs", SQL_MAXIMA + "SELECT vid, t, round(p, 6) AS p FROM pk"))(
    lambda s, d: r6(S.local_maxima(S.smooth(fused(s, d), 3, block=BLK), 0.1, block=BLK), "p")
)
query("ser4_nms", sql("probs", SQL_NMS + "SELECT vid, t, round(p, 6) AS p FROM nms"))(
    lambda s, d: r6(S.nms(S.local_maxima(S.smooth(fused(s, d), 3, block=BLK), 0.1, block=BLK), 8, block=BLK), "p")
)
query("ser5_candidates", sql("probs", SQL_CAND + "SELECT * FROM cand"))(lambda s, d: cands(s, d))

query("ser6_runs_strict", sql("probs", SQL_ONE + """,
f AS (SELECT *, lag(t) OVER w AS lt, lag(p) OVER w AS lp FROM one WINDOW w AS (PARTITION BY vid ORDER BY t)),
h AS (SELECT *, sum(CASE WHEN lt IS NULL OR lp < 0.3 OR t - lt > 2 THEN 1 ELSE 0 END) OVER (PARTITION BY vid ORDER BY t) AS run
      FROM f WHERE p >= 0.3)
SELECT vid, min(t) AS start_s, max(t) AS end_s FROM h GROUP BY vid, run"""))(
    lambda s, d: S.runs_strict(one(s, d), 0.3, 2, BLK)
)
query("ser7_runs_bridged", sql("probs", SQL_ONE + """,
h AS (SELECT *, lag(t) OVER (PARTITION BY vid ORDER BY t) AS lt FROM one WHERE p >= 0.3),
r AS (SELECT *, sum(CASE WHEN lt IS NULL OR t - lt > 2 THEN 1 ELSE 0 END) OVER (PARTITION BY vid ORDER BY t) AS run FROM h)
SELECT vid, min(t) AS start_s, max(t) AS end_s, round(avg(p), 6) AS mean_conf FROM r GROUP BY vid, run"""))(
    lambda s, d: r6(S.runs_bridged(one(s, d), 0.3, 2), "mean_conf")
)

SQL_Z = """
z AS (SELECT s.vid, s.t, (s.motion - m.mu) / m.sd AS z FROM sig s JOIN (
  SELECT vid, avg(motion) AS mu, stddev_pop(motion) + 1e-8 AS sd FROM sig GROUP BY vid) m USING (vid))"""
# the hop series has to be dense, so quiet hops are filled with motion zero
SQL_ZD = """
zl AS (SELECT vid, max(t) + 1 AS n FROM sig GROUP BY 1),
zg AS (SELECT vid, CAST(unnest(range(n)) AS int) AS t FROM zl),
dense AS (SELECT zg.vid, zg.t, coalesce(motion, 0.0) AS motion FROM zg LEFT JOIN sig USING (vid, t)),
zz AS (SELECT s.vid, s.t, (s.motion - m.mu) / m.sd AS z FROM dense s JOIN (
  SELECT vid, avg(motion) AS mu, stddev_pop(motion) + 1e-8 AS sd FROM dense GROUP BY vid) m USING (vid)),
hot AS (SELECT *, lag(t) OVER (PARTITION BY vid ORDER BY t) AS lt FROM zz WHERE z > 0.2),
runs AS (SELECT *, sum(CASE WHEN lt IS NULL OR t - lt > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY vid ORDER BY t) AS run FROM hot),
bursts AS (SELECT vid, min(t) * 0.5::double AS start_t, (max(t) + 1) * 0.5::double AS end_t FROM runs GROUP BY vid, run),
burst AS (SELECT *, start_t + (end_t - start_t) / 2 AS mid FROM bursts WHERE end_t - start_t >= 1.0)"""


def bursts(spark, sf):
    dense = S.densify(V.sig(spark, sf).select("vid", "t", "motion"), "motion")
    return S.bursts(S.zscore(dense, "motion"), 0.2, 1.0, 0.5)


query("ser8_zscore", sql("sig", SQL_Z + " SELECT vid, t, round(z, 6) AS z, z > 0.5 AS above FROM z"))(
    lambda s, d: S.zscore(V.sig(s, d), "motion").select("vid", "t", F.round("z", 6).alias("z"), (F.col("z") > 0.5).alias("above"))
)
query("ser9_bursts", sql("sig", SQL_ZD + " SELECT * FROM burst"))(bursts)
query("ser10_refractory", sql("sig", SQL_ZD + """,
o AS (SELECT vid, mid, row_number() OVER (PARTITION BY vid ORDER BY mid) AS rn FROM burst),
w AS (SELECT DISTINCT vid, CAST(0 AS bigint) AS rn, CAST(-999.0 AS double) AS last, false AS hit FROM o
      UNION ALL
      SELECT w.vid, o.rn, CASE WHEN o.mid - w.last >= 3.0 THEN o.mid ELSE w.last END, o.mid - w.last >= 3.0
      FROM w JOIN o ON o.vid = w.vid AND o.rn = w.rn + 1)
SELECT vid, last AS t FROM w WHERE hit"""))(lambda s, d: S.refractory(bursts(s, d), 3.0))

SQL_HYST = """
o AS (SELECT vid, t, motion AS m, row_number() OVER (PARTITION BY vid ORDER BY t) AS rn FROM sig),
step AS (
  SELECT vid, CAST(0 AS bigint) AS rn, CAST(NULL AS int) AS rs, CAST(0 AS int) AS rl, CAST(NULL AS int) AS os,
         CAST(NULL AS int) AS ws, CAST(NULL AS int) AS we, CAST('' AS varchar) AS src, CAST(-1 AS int) AS t
  FROM (SELECT DISTINCT vid FROM o)
  UNION ALL
  SELECT vid, rn, CASE WHEN forced THEN NULL ELSE rs END, CASE WHEN forced THEN 0 ELSE rl END,
         CASE WHEN closed OR forced THEN NULL ELSE os END, CASE WHEN closed OR forced THEN os END,
         CASE WHEN closed OR forced THEN t END, CASE WHEN closed THEN 'motion' WHEN forced THEN 'motion_auto_close' ELSE '' END, t
  FROM (SELECT *, os IS NOT NULL AND m < 0.5 AS closed, os IS NOT NULL AND m >= 0.5 AND t - os >= 6 AS forced FROM (
    SELECT vid, rn, t, m, rs, rl, CASE WHEN os0 IS NULL AND m >= 1.0 AND rl >= 2 THEN rs ELSE os0 END AS os FROM (
      SELECT o.vid, o.rn, o.t, o.m, s.os AS os0, CASE WHEN o.m >= 1.0 THEN coalesce(s.rs, o.t) END AS rs,
             CASE WHEN o.m >= 1.0 THEN CASE WHEN s.rs IS NULL THEN 1 ELSE s.rl + 1 END ELSE 0 END AS rl
      FROM step s JOIN o ON o.vid = s.vid AND o.rn = s.rn + 1)))),
hyst AS (
  SELECT vid, ws AS start_s, we AS end_s, src AS source FROM step WHERE ws IS NOT NULL
  UNION ALL
  SELECT vid, os, max_t + 1, 'motion_eof' FROM (
    SELECT vid, arg_max(os, rn) FILTER (os IS NOT NULL OR true) AS x, max(rn) AS mrn, max(t) AS max_t FROM step GROUP BY vid) l
  JOIN step USING (vid) WHERE step.rn = l.mrn AND os IS NOT NULL)"""
SQL_HYST = SQL_HYST.replace("arg_max(os, rn) FILTER (os IS NOT NULL OR true) AS x, ", "")


def hyst(spark, sf):
    return S.hysteresis(V.sig(spark, sf), "motion", 1.0, 0.5, 2, 6)


query("ser11_hysteresis", sql("sig", SQL_HYST + " SELECT vid, start_s, end_s, source FROM hyst"))(hyst)
query("ser11_hysteresis_high_stop", sql("sig", SQL_HYST.replace("m < 0.5", "m < 1.3").replace("m >= 0.5", "m >= 1.3") + " SELECT vid, start_s, end_s, source FROM hyst"))(
    lambda s, d: S.hysteresis(V.sig(s, d), "motion", 1.0, 1.3, 2, 6)
)

query("ser12_side_runs", sql("sig", """
k AS (SELECT vid, t, CASE WHEN celeb > 0 AND celeb_side <> 'none' THEN celeb_side ELSE '' END AS side,
             row_number() OVER (PARTITION BY vid ORDER BY t) AS i FROM sig),
l AS (SELECT *, lag(side) OVER (PARTITION BY vid ORDER BY i) AS ps FROM k),
r AS (SELECT *, sum(CASE WHEN ps IS NULL OR ps <> side THEN 1 ELSE 0 END) OVER (PARTITION BY vid ORDER BY i) AS run FROM l),
q AS (SELECT *, i - min(i) OVER (PARTITION BY vid, run) AS pos FROM r WHERE side <> ''),
c AS (SELECT vid, run, pos // 2 AS chunk, min(t) AS a, max(t) AS b, count(*) AS n, min(side) AS celeb_side FROM q GROUP BY ALL),
e AS (SELECT vid, max(t) + 1 AS dur FROM sig GROUP BY vid)
SELECT vid, greatest(a - 20, 0) AS start_s, least(b + 15, dur) AS end_s, celeb_side FROM c JOIN e USING (vid) WHERE n = 2"""))(
    lambda s, d: S.side_runs(V.sig(s, d), 2, 20, 15)
)
query("ser13_trigger_windows", sql("sig", """
e AS (SELECT vid, max(t) + 1 AS dur FROM sig GROUP BY vid)
SELECT vid, t, greatest(t - 25, 0) AS start_s, least(t + 15, dur) AS end_s, 'faceoff' AS source
FROM sig JOIN e USING (vid) WHERE faceoff >= 0.8
UNION ALL
SELECT vid, t, greatest(t - 25, 0), least(t + 20, dur), 'crowd_roar' FROM sig JOIN e USING (vid) WHERE activity >= 0.15"""))(
    lambda s, d: S.trigger_windows(V.sig(s, d), "faceoff", 0.8, 25, 15, "faceoff").unionByName(
        S.trigger_windows(V.sig(s, d), "activity", 0.15, 25, 20, "crowd_roar")
    )
)

SQL_SEQ = SQL_FUSE + """,
n AS (SELECT vid, max(t) + 1 AS n FROM fused GROUP BY vid),
b AS (SELECT vid, CAST(floor(CAST(0.1 AS double) * n) AS int) AS lo, CAST(floor(CAST(0.9 AS double) * n) AS int) AS hi FROM n)"""
query("ser14_sequences", sql("probs", SQL_SEQ + """,
st AS (SELECT vid, hi, CAST(unnest(range(lo, greatest(lo + 1, hi - 32 + 1), 4)) AS int) AS s FROM b)
SELECT st.vid, s AS seq_start, count(*) AS n_ticks, round(list_sum(list(p ORDER BY t)), 6) AS total,
       round(arg_min(p, t), 6) AS head, round(arg_max(p, t), 6) AS tail
FROM st JOIN fused f ON f.vid = st.vid AND f.t >= s AND f.t < s + 32 WHERE s + 32 <= hi GROUP BY 1, 2"""))(
    lambda s, d: S.sequences(fused(s, d), 32, 4, 0.1, 0.9).select(
        "vid", "seq_start", F.size("seq").cast("long").alias("n_ticks"),
        F.round(F.aggregate("seq", F.lit(0.0), lambda a, x: a + x), 6).alias("total"),
        F.round(F.col("seq")[0], 6).alias("head"), F.round(F.element_at("seq", -1), 6).alias("tail"),
    )
)


def _slice_scores(spark, sf):
    """Stand-in model: a slice predicts a blend of its mean and the input."""
    x = S.covering_starts(fused(spark, sf), 32, 4)
    mean = x.groupBy("vid", "seq_start").agg(F.avg("p").alias("m"))
    return x.join(mean, ["vid", "seq_start"]).select(
        "vid", "seq_start", "t", (F.sqrt("m") / 3 + F.sqrt("p") / 7).alias("pred")
    )


query("ser15_overlap_average", sql("probs", SQL_FUSE + """,
n AS (SELECT vid, max(t) + 1 AS n FROM fused GROUP BY vid),
st AS (SELECT vid, CAST(unnest(range(0, greatest(1, n - 31), 4)) AS int) AS s FROM n
       UNION SELECT vid, CAST(greatest(n - 32, 0) AS int) FROM n),
x AS (SELECT f.vid, s, f.t, f.p FROM st JOIN fused f ON f.vid = st.vid AND f.t >= s AND f.t < s + 32),
m AS (SELECT vid, s, avg(p) AS m FROM x GROUP BY 1, 2)
SELECT vid, t, round(avg(sqrt(m) / 3 + sqrt(p) / 7), 6) AS p FROM x JOIN m USING (vid, s) GROUP BY 1, 2"""))(
    lambda s, d: r6(S.overlap_average(_slice_scores(s, d)), "p")
)

SQL_LABELS = """
len AS (SELECT vid, CAST(max(t) + 1 AS int) AS n FROM ev GROUP BY vid),
lg AS (SELECT vid, CAST(unnest(range(n)) AS int) AS t FROM len),
lab AS (SELECT lg.vid, lg.t, CASE WHEN EXISTS (SELECT 1 FROM gt WHERE gt.vid = lg.vid AND gt.action = 'Goals'
         AND lg.t >= gt.start_s - 1 AND lg.t < gt.end_s + 2) THEN 1 ELSE 0 END AS label FROM lg)"""


def labels(spark, sf):
    length = V.ev(spark, sf).groupBy("vid").agg((F.max("t") + 1).alias("n"))
    return S.derive_labels(V.gt(spark, sf).filter("action = 'Goals'").select("vid", "start_s", "end_s"), length, 1)


query("ser16_derive_labels", sql("ev gt", SQL_LABELS + " SELECT vid, t, label FROM lab"))(labels)
query("ser17_class_weight", sql("ev gt", SQL_LABELS + """
SELECT count(*) AS n, CAST(sum(label) AS bigint) AS pos, greatest(1.0, (count(*) - sum(label)) / greatest(1, sum(label))) AS pos_weight FROM lab"""))(
    lambda s, d: S.class_weight(labels(s, d))
)

SQL_FRAMES = """
fr AS (SELECT l_suppkey % 10 AS vid, l_orderkey AS frame, l_discount AS rms, l_quantity AS sc, l_tax AS onset, l_extendedprice AS sro,
              [l_quantity, l_discount * 10, l_tax * 10] AS mfcc FROM lineitem),
edge AS (SELECT *, floor(frame / 2.5) AS g FROM fr),
sec AS (SELECT *, CAST(CASE WHEN frame < round_even(g * 2.5, 0) THEN g - 1 WHEN frame >= round_even((g + 1) * 2.5, 0) THEN g + 1 ELSE g END AS int) AS t FROM edge)"""
query("ser18_rollup_frames", sql("", SQL_FRAMES + """
SELECT vid, t, round(avg(rms), 6) AS rms_mean, max(rms) AS rms_max, round(max(rms) - min(rms), 6) AS rms_dyn,
       round(avg(sc), 6) AS sc_mean, round(stddev_pop(sc), 6) AS sc_std, round(avg(sro), 4) AS sro_mean,
       round(avg(onset), 6) AS onset_mean, max(onset) AS onset_max,
       round(avg(mfcc[1]), 6) AS mfcc0, round(avg(mfcc[2]), 6) AS mfcc1, round(avg(mfcc[3]), 6) AS mfcc2
FROM sec GROUP BY vid, t"""))(
    lambda s, d: r6(
        S.rollup_frames(
            V.table(s, d, "lineitem").selectExpr(
                "l_suppkey % 10 as vid", "l_orderkey as frame", "l_discount as rms", "l_quantity as sc", "l_tax as onset",
                "l_extendedprice as sro", "array(l_quantity, l_discount * 10, l_tax * 10) as mfcc",
            ),
            2.5, n_mfcc=3,
        ),
        "rms_mean", "rms_dyn", "sc_mean", "sc_std", "onset_mean", "mfcc0", "mfcc1", "mfcc2",
    ).withColumn("sro_mean", F.round("sro_mean", 4))
)
query("ser19_duration", sql("ev", """
d AS (SELECT vid, max(t) AS duration FROM ev GROUP BY vid)
SELECT vid, coalesce(duration, 7200) AS duration FROM (SELECT DISTINCT c_custkey AS vid FROM customer) LEFT JOIN d USING (vid)"""))(
    lambda s, d: S.duration(V.ev(s, d), V.table(s, d, "customer").selectExpr("c_custkey as vid"))
)
