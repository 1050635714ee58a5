"""Season-statistics queries over clip records."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import views as V
from ..operators import season as S
from ..views import sql
from .registry import query
from .series import r6

C = V.clips
QUAL = "CASE {c} WHEN 'Excellent' THEN 3.0::double WHEN 'Good' THEN 2.0 WHEN 'Average' THEN 1.0 WHEN 'Poor' THEN 0.0 END"
REBO = "CASE rebound_control_rank WHEN 'Killed (Elite)' THEN 3.0::double WHEN 'Steered to Low-Danger Zone' THEN 2.0 WHEN 'Uncontrolled into High-Danger Zone' THEN 1.0 WHEN 'Goal Allowed' THEN 0.0 END"
QA, QS = QUAL.format(c="cover_angle_rank"), QUAL.format(c="squareness_rank")

SQL_CONF = """
cn AS (SELECT *, (position_confidence - 1) / 4::double AS a, (coaching_confidence - 1) / 4::double AS b, CASE WHEN goals > 0 THEN beaten_confidence END AS c FROM clips),
cf AS (SELECT *, coalesce((coalesce(a * 0.45::double, 0) + coalesce(b * 0.35::double, 0) + coalesce(c * 0.2::double, 0)) / nullif(CASE WHEN a IS NOT NULL THEN 0.45::double ELSE 0 END + CASE WHEN b IS NOT NULL THEN 0.35::double ELSE 0 END + CASE WHEN c IS NOT NULL THEN 0.2::double ELSE 0 END, 0), 0.5) * CASE WHEN n_caveats > 0 THEN 0.85::double ELSE 1 END AS confidence FROM cn)"""
query("sea1_clip_confidence", sql("clips", SQL_CONF + """
SELECT clip_no, round(confidence, 8) AS confidence, CASE WHEN round(confidence, 9) >= 0.7 THEN 'high' WHEN round(confidence, 9) >= 0.45 THEN 'medium' ELSE 'low' END AS band, round(confidence, 9) < 0.45 AS needs_review FROM cf"""))(
    lambda s, d: S.clip_confidence(C(s, d)).select("clip_no", F.round("confidence", 8).alias("confidence"), "band", "needs_review")
)

SQL_LEAKS = """
sc AS (SELECT * FROM clips WHERE goals > 0 OR saves > 0),
bs AS (SELECT season, count(*) AS n_total, count(*) FILTER (goals > 0) AS goals_total FROM sc GROUP BY 1),
wk AS (SELECT season, side, CAST(goals > 0 AS int) AS g, 'depth' AS dimension, coalesce(position_confidence, 3) AS conf FROM sc WHERE depth_rank IN ('Conservative (C)','Defensive (D)')
  UNION ALL SELECT season, side, CAST(goals > 0 AS int), 'angle', coalesce(position_confidence, 3) FROM sc WHERE cover_angle_rank IN ('Average','Poor')
  UNION ALL SELECT season, side, CAST(goals > 0 AS int), 'squareness', coalesce(position_confidence, 3) FROM sc WHERE squareness_rank IN ('Average','Poor')
  UNION ALL SELECT season, side, CAST(goals > 0 AS int), 'rebound', coalesce(coaching_confidence, 3) FROM sc WHERE rebound_control_rank IN ('Uncontrolled into High-Danger Zone','Goal Allowed')),
w2 AS (SELECT *, 'all' AS scope FROM wk UNION ALL SELECT *, side FROM wk WHERE side <> 'unknown'),
cd AS (SELECT season, dimension, scope, count(*) AS n_leak, CAST(sum(g) AS bigint) AS goals_leak, sum(conf) AS c, sum(g * conf) AS gc FROM w2 GROUP BY 1, 2, 3),
lk AS (SELECT season, dimension, scope, n_leak, goals_leak, n_total, goals_total, goals_total / n_total AS base_rate, goals_leak / n_leak AS leak_rate, gc / c AS weighted_leak_rate, (goals_leak / n_leak) / greatest(goals_total / n_total, 0.05) AS rr,
   c / n_leak / 5 AS avg_conf, goals_leak - n_leak * (goals_total / n_total) AS excess_goals FROM cd JOIN bs USING (season)),
lks AS (SELECT *, excess_goals * log2(rr) * avg_conf AS score, avg_conf < 0.5 AS hint FROM lk)"""
query("sea2_leak_candidates", sql("clips", SQL_LEAKS + """
SELECT season, dimension, scope, n_leak, goals_leak, n_total, goals_total, round(base_rate, 6) AS base_rate, round(leak_rate, 6) AS leak_rate, round(weighted_leak_rate, 6) AS weighted_leak_rate, round(rr, 6) AS rr, round(avg_conf, 5) AS avg_conf,
  round(excess_goals, 6) AS excess_goals, round(score, 6) AS score, hint FROM lks"""))(
    lambda s, d: r6(S.leaks(C(s, d)), "base_rate", "leak_rate", "weighted_leak_rate", "rr", "excess_goals", "score").withColumn("avg_conf", F.round("avg_conf", 5))
)


def leaky(spark, sf):
    """Clips in which one weak spot costs most goals."""
    weak = "depth_rank in ('Conservative (C)', 'Defensive (D)') or rebound_control_rank = 'Goal Allowed' and side = 'left'"
    return C(spark, sf).withColumn("goals", F.expr(f"if({weak}, if(clip_no % 4 <> 0, greatest(goals, 1), goals), if(clip_no % 5 = 0, goals, 0))"))


SQL_LEAKY = """
lc AS (SELECT * REPLACE (CASE WHEN depth_rank IN ('Conservative (C)', 'Defensive (D)') OR rebound_control_rank = 'Goal Allowed' AND side = 'left' THEN CASE WHEN clip_no % 4 <> 0 THEN greatest(goals, 1) ELSE goals END
  WHEN clip_no % 5 = 0 THEN goals ELSE 0 END AS goals) FROM clips),""" + SQL_LEAKS.replace("FROM clips WHERE", "FROM lc WHERE")
query("sea2_leaks", sql("clips", SQL_LEAKY + """,
ok AS (SELECT * FROM lks WHERE n_leak >= CASE WHEN scope = 'all' THEN 5 ELSE 6 END AND goals_leak >= 3 AND rr >= 1.5 AND base_rate >= 0.05),
j AS (SELECT o.*, a.n_leak AS an, a.score AS asc_ FROM ok o LEFT JOIN ok a ON a.season = o.season AND a.dimension = o.dimension AND a.scope = 'all'),
f AS (SELECT *, scope <> 'all' AND coalesce(n_leak / an > 0.6, false) AS near FROM j),
k AS (SELECT * FROM f x WHERE NOT (near AND score < 0.9 * asc_) AND NOT (scope = 'all' AND EXISTS (SELECT 1 FROM f y WHERE y.season = x.season AND y.dimension = x.dimension AND y.near AND y.score >= 0.9 * y.asc_)))
SELECT season, dimension, scope, n_leak, goals_leak, round(score, 6) AS score, CAST(rank AS int) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY season ORDER BY score DESC, dimension, scope) AS rank FROM k) WHERE rank <= 5"""))(
    lambda s, d: r6(S.promoted_leaks(S.leaks(leaky(s, d))), "score").select("season", "dimension", "scope", "n_leak", "goals_leak", "score", "rank")
)
CUES = "breakaway|rush|odd-man|2-on-1|3-on-2|cross-ice|royal road|backdoor|wide open|in alone"
SQL_DANGER = f"""
b0 AS (SELECT *, CASE WHEN location LIKE '%slot%' OR location LIKE '%in close%' THEN 3 WHEN location LIKE '%circle%' OR location LIKE '%wing%' THEN 2 WHEN location LIKE '%point%' OR location LIKE '%behind net%' THEN 1 ELSE 2 END AS base FROM shots),
b1 AS (SELECT *, CASE WHEN release IN ('one-timer','redirect-tip') THEN CASE WHEN base >= 2 THEN 3 ELSE 2 END ELSE base END AS u1 FROM b0),
dg AS (SELECT *, (['low','medium','high'])[least(least(u1 + CASE WHEN outcome = 'save' AND rebounds > 0 THEN 1 ELSE 0 END, 3) + CASE WHEN regexp_matches(lower(text), '{CUES}') THEN 1 ELSE 0 END, 3)] AS danger FROM b1)"""
query("sea3_shot_danger", sql("shots", SQL_DANGER + " SELECT clip_no, shot_no, outcome, danger FROM dg"))(
    lambda s, d: S.shot_danger(V.shots(s, d)).select("clip_no", "shot_no", "outcome", "danger")
)
query("sea3_clip_danger", sql("clips", f"""
SELECT clip_no, CASE WHEN goals > 0 OR rebounds > 0 THEN 'high' WHEN sog < shots THEN 'medium' WHEN regexp_matches(lower(cue_text), '{CUES}') THEN 'high' ELSE 'medium' END AS danger FROM clips"""))(
    lambda s, d: S.clip_danger(C(s, d)).select("clip_no", "danger")
)
SQL_PERIOD = """
sp AS (SELECT vid, min(start_s) AS sp_a, max(end_s) AS sp_b FROM {t} GROUP BY vid),
pd AS (SELECT t.*, CAST(greatest(least(ceil((start_s - sp_a) / (sp_b - sp_a) * 3), 3), 1) AS int) AS period FROM {t} t JOIN sp USING (vid))"""
query("sea5_approx_period", sql("clips", SQL_PERIOD.format(t="clips") + " SELECT clip_no, period FROM pd"))(
    lambda s, d: S.approx_period(C(s, d)).select("clip_no", "period")
)


def dangerous(spark, sf):
    return S.approx_period(S.shot_danger(V.shots(spark, sf)).withColumn("end_s", F.col("start_s") + 20))


query("sea4_danger_splits", sql("shots", SQL_DANGER + ", dge AS (SELECT *, start_s + 20 AS end_s FROM dg)," + SQL_PERIOD.format(t="dge") + """,
o AS (SELECT * FROM pd WHERE outcome IN ('save','goal')),
u AS (SELECT 'danger' AS split, danger AS bucket, outcome FROM o UNION ALL SELECT 'side', side, outcome FROM o UNION ALL SELECT 'period', CAST(period AS varchar), outcome FROM o),
g AS (SELECT split, bucket, count(*) AS n, count(*) FILTER (outcome = 'save') AS saves FROM u GROUP BY 1, 2), h AS (SELECT *, saves / n AS p, n::double AS m FROM g)
SELECT split, bucket, n, saves, round(p, 6) AS sv_pct, round((p + 3.8416 / (2 * m) - 1.96 * sqrt((p * (1 - p) + 3.8416 / (4 * m)) / m)) / (1 + 3.8416 / m), 6) AS ci_lo,
  round((p + 3.8416 / (2 * m) + 1.96 * sqrt((p * (1 - p) + 3.8416 / (4 * m)) / m)) / (1 + 3.8416 / m), 6) AS ci_hi, n < 5 AS small_sample FROM h"""))(
    lambda s, d: r6(S.danger_splits(dangerous(s, d)), "sv_pct", "ci_lo", "ci_hi")
)
query("sea6_beaten_map", sql("clips", """
z AS (SELECT unnest(['glove_high','glove_low','blocker_high','blocker_low','five_hole','body_other','unknown']) AS zone),
g AS (SELECT beaten_location AS zone, CAST(sum(goals) AS bigint) AS goals, count(*) AS clips FROM clips WHERE goals > 0 GROUP BY 1),
x AS (SELECT zone, coalesce(goals, 0) AS goals, coalesce(clips, 0) AS clips FROM z LEFT JOIN g USING (zone)),
t AS (SELECT sum(goals) AS al, sum(goals) FILTER (zone <> 'unknown') AS loc FROM x), m AS (SELECT zone AS top FROM x WHERE zone <> 'unknown' ORDER BY goals DESC, zone DESC LIMIT 1)
SELECT zone, goals, clips, round(goals / al, 6) AS pct_all, CASE WHEN zone <> 'unknown' THEN round(goals / loc, 6) END AS pct_located, zone = top AS dominant FROM x, t, m"""))(
    lambda s, d: r6(S.beaten_map(C(s, d)), "pct_all", "pct_located")
)
query("sea6_zone_clips", sql("clips", """
SELECT vid, CASE WHEN beaten_location IN ('glove_high','glove_low','blocker_high','blocker_low','five_hole','body_other') THEN beaten_location ELSE 'unknown' END AS zone, clip_no, start_s, goals,
  CAST(row_number() OVER (PARTITION BY vid, CASE WHEN beaten_location IN ('glove_high','glove_low','blocker_high','blocker_low','five_hole','body_other') THEN beaten_location ELSE 'unknown' END ORDER BY start_s, clip_no) AS int) AS pos
FROM clips WHERE goals > 0"""))(lambda s, d: S.zone_clips(C(s, d)))
query("sea6_zone_ranks", sql("clips", "SELECT beaten_location AS zone, depth_rank AS rank, count(*) AS n FROM clips WHERE goals > 0 GROUP BY 1, 2"))(
    lambda s, d: S.zone_ranks(C(s, d))
)

# -- search ------------------------------------------------------------------------
SQL_SEARCH = SQL_CONF + "," + SQL_PERIOD.format(t="cf") + """,
sr AS (SELECT * FROM pd WHERE (goals > 0 OR rebounds > 0) AND side IN ('left','right') AND period IN (1, 2) AND shot_location IN ('slot','crease','left circle')
  AND cover_angle_rank IN ('Average','Poor') AND round(confidence, 9) >= 0.3)"""


def searched(spark, sf):
    x = S.approx_period(S.clip_confidence(C(spark, sf)))
    return S.clip_search(
        x, outcome=("goal", "rebound", "bogus"), side=("left", "right", "up"), period=(1, 2, 9), location=("slot", "crease", "left circle"),
        ranks=(("cover_angle", "<=", "average"), ("style", ">=", "good")), min_confidence=0.3,
    )


query("flt11_clip_search", sql("clips", SQL_SEARCH + " SELECT clip_no FROM sr"))(lambda s, d: searched(s, d).select("clip_no"))
query("sea8_search_counts", sql("clips", SQL_SEARCH + """
SELECT 'total' AS kind, 'all' AS key, count(*) AS n FROM sr UNION ALL SELECT 'saves', 'all', CAST(sum(saves) AS bigint) FROM sr UNION ALL SELECT 'sog', 'all', CAST(sum(sog) AS bigint) FROM sr
UNION ALL SELECT 'outcome', 'goal', count(*) FILTER (goals > 0) FROM sr UNION ALL SELECT 'outcome', 'save', count(*) FILTER (saves > 0) FROM sr UNION ALL SELECT 'outcome', 'shot', count(*) FILTER (shots > 0) FROM sr
UNION ALL SELECT 'outcome', 'rebound', count(*) FILTER (rebounds > 0) FROM sr UNION ALL SELECT 'side', side, count(*) FROM sr GROUP BY side UNION ALL SELECT 'zone', beaten_location, count(*) FROM sr GROUP BY beaten_location
UNION ALL SELECT 'period', CAST(period AS varchar), count(*) FROM sr GROUP BY period"""))(lambda s, d: S.search_counts(searched(s, d)))
query("jon20_with_game", sql("clips games", "SELECT clip_no, target_team, opponent_team, g.season AS game_season FROM clips c LEFT JOIN games g ON g.vid = c.vid"))(
    lambda s, d: S.with_game(C(s, d), V.games(s, d)).select("clip_no", "target_team", "opponent_team", "game_season")
)

# -- reviews -----------------------------------------------------------------------
SQL_VER = """
lr AS (SELECT clip_id, arg_max(type, ts * 1000000::hugeint + pos) AS last FROM reviews WHERE type IN ('Accurate','Correction') GROUP BY 1),
vs AS (SELECT c.*, CASE last WHEN 'Accurate' THEN 'verified' WHEN 'Correction' THEN 'corrected' ELSE 'unreviewed' END AS state FROM clips c LEFT JOIN lr ON lr.clip_id = c.clip_no)"""


def states(spark, sf):
    return S.verification(C(spark, sf).withColumn("clip_id", F.col("clip_no")), V.reviews(spark, sf))


query("jon19_verification", sql("clips reviews", SQL_VER + " SELECT clip_no, state FROM vs"))(lambda s, d: states(s, d).select("clip_no", "state"))
query("sea13_verified_pct", sql("clips reviews", SQL_VER + """
SELECT vid, count(*) FILTER (state = 'verified') AS verified, count(*) FILTER (state = 'corrected') AS corrected, count(*) FILTER (state = 'unreviewed') AS unreviewed, count(*) AS total,
  round_even(100.0::double * count(*) FILTER (state = 'verified') / greatest(count(*), 1), 0) AS verified_pct FROM vs GROUP BY ROLLUP (vid)"""))(
    lambda s, d: S.verified_pct(states(s, d))
)
query("sea9_review_queue", sql("clips reviews", SQL_VER + """
SELECT clip_no, state <> 'unreviewed' AS reviewed, CASE WHEN n_caveats > 0 THEN 100 ELSE 0 END + (5 - least(coalesce(position_confidence, 3), coaching_confidence)) * 10 + (5 - (coalesce(position_confidence, 3) + coaching_confidence) / 2::double) AS priority FROM vs"""))(
    lambda s, d: S.review_queue(states(s, d)).select("clip_no", "reviewed", F.col("priority").cast("double").alias("priority"))
)

# -- agenda and reels -----------------------------------------------------------------
SQL_INS = f"""
ins0 AS (SELECT *, least(coaching_confidence, coalesce(position_confidence, 3)) / 5::double AS conf FROM clips),
ins AS (SELECT *, (4.0::double * CASE WHEN goals > 0 THEN 1.0 ELSE 0.0 END + 2.0::double * least(saves, 3) / 3 + 1.0::double * least(sog, 3) / 3 + 2.5::double * coalesce(abs({REBO} - 1.5) / 1.5, 0) + 1.5::double * ((abs({QA} - 1.5) + abs({QS} - 1.5)) / 3))
    * conf * CASE WHEN n_caveats > 0 THEN 0.85::double ELSE 1.0 END AS score,
  CASE WHEN goals > 0 THEN 'goal' WHEN rebound_control_rank = 'Killed (Elite)' OR (saves > 0 AND (cover_angle_rank = 'Excellent' OR squareness_rank = 'Excellent')) THEN 'elite_save' ELSE 'other' END AS kind FROM (SELECT *, max(conf) OVER (PARTITION BY vid, season) AS best FROM ins0) WHERE conf >= 0.4 OR best < 0.4)"""


def scored(spark, sf):
    return S.instruction_score(C(spark, sf)).withColumn("score", F.round("score", 6))


query("sea7_instruction_score", sql("clips", SQL_INS + " SELECT clip_no, kind, round(score, 6) AS score FROM ins"))(lambda s, d: scored(s, d).select("clip_no", "kind", "score"))
query("sea7_agenda", sql("clips", SQL_INS + """,
i2 AS (SELECT * REPLACE (round(score, 6) AS score) FROM ins),
k AS (SELECT *, row_number() OVER (PARTITION BY vid, season, kind ORDER BY score DESC, clip_no) AS r FROM i2),
p AS (SELECT *, row_number() OVER (PARTITION BY vid, season ORDER BY (kind <> 'other' AND r <= 2) DESC, score DESC, clip_no) AS p FROM k),
q AS (SELECT *, row_number() OVER (PARTITION BY vid, season ORDER BY score DESC, clip_no) AS rn FROM p WHERE p <= 5),
w AS (SELECT DISTINCT vid, season, CAST(0 AS bigint) AS rn, CAST([] AS struct(g varchar, s int)[]) AS st, CAST(NULL AS bigint) AS clip_no FROM q
  UNION ALL SELECT w.vid, w.season, q.rn, CASE WHEN len(list_filter(w.st, lambda s: s.g = q.game::varchar AND abs(s.s - q.start_s) <= 2)) > 0 THEN w.st ELSE list_append(w.st, {'g': q.game::varchar, 's': q.start_s}) END,
    CASE WHEN len(list_filter(w.st, lambda s: s.g = q.game::varchar AND abs(s.s - q.start_s) <= 2)) > 0 THEN NULL ELSE q.clip_no END FROM w JOIN q ON q.vid = w.vid AND q.season = w.season AND q.rn = w.rn + 1)
SELECT q.vid, q.season, q.clip_no, q.kind, q.start_s, q.score, CAST(row_number() OVER (PARTITION BY q.vid, q.season ORDER BY CASE q.kind WHEN 'elite_save' THEN 0 WHEN 'goal' THEN 1 ELSE 2 END, q.score DESC, q.clip_no) AS int) AS pos
FROM w JOIN q USING (vid, season, clip_no)"""))(lambda s, d: S.agenda(scored(s, d)))

SQL_WEEK = SQL_INS + """,
i2 AS (SELECT * REPLACE (round(score, 6) AS score), game::varchar AS grp FROM ins),
c0 AS (SELECT *, row_number() OVER (PARTITION BY season, grp, kind ORDER BY score DESC, clip_no) AS g FROM i2),
c1 AS (SELECT *, row_number() OVER (PARTITION BY season, kind ORDER BY score DESC, clip_no) AS r FROM c0 WHERE g <= 1),
tn AS (SELECT 1 AS p, * FROM c1 WHERE kind = 'goal' AND r <= 6 UNION ALL SELECT 2, * FROM c1 WHERE kind = 'elite_save' AND r <= 6 UNION ALL SELECT 3, * FROM c1 WHERE r <= 6),
tq AS (SELECT *, row_number() OVER (PARTITION BY season ORDER BY p, score DESC, clip_no) AS rn FROM tn),
pk AS (SELECT DISTINCT season, CAST(0 AS bigint) AS rn, CAST([] AS struct(c bigint, g varchar, k varchar)[]) AS st FROM tq
  UNION ALL SELECT pk.season, q.rn, CASE WHEN len(st) < 3 AND (q.p = 3 OR len(list_filter(st, lambda s: s.k = q.kind)) < 2) AND len(list_filter(st, lambda s: s.g = q.grp)) < 1 AND len(list_filter(st, lambda s: s.c = q.clip_no)) = 0
    THEN list_append(st, {'c': q.clip_no, 'g': q.grp, 'k': q.kind}) ELSE st END FROM pk JOIN tq q ON q.season = pk.season AND q.rn = pk.rn + 1),
fp AS (SELECT season, unnest(arg_max(st, rn)) AS u FROM pk GROUP BY season),
px AS (SELECT c.* FROM fp JOIN c1 c ON c.clip_no = fp.u.c AND c.season = fp.season),
pr AS (SELECT *, row_number() OVER (PARTITION BY season ORDER BY score, clip_no DESC) AS low, count(*) OVER (PARTITION BY season) AS n, min(kind) OVER (PARTITION BY season) AS k0, max(kind) OVER (PARTITION BY season) AS k1 FROM px),
ot AS (SELECT c.*, row_number() OVER (PARTITION BY c.season ORDER BY c.score DESC, c.clip_no) AS o FROM c1 c JOIN (SELECT DISTINCT season, k0 FROM pr WHERE k0 = k1 AND k0 <> 'other' AND n > 1) a ON a.season = c.season
  AND c.kind = CASE a.k0 WHEN 'goal' THEN 'elite_save' ELSE 'goal' END AND c.r <= 6 AND NOT EXISTS (SELECT 1 FROM pr WHERE pr.season = c.season AND pr.low > 1 AND pr.grp = c.grp)),
fin AS (SELECT season, clip_no, kind, start_s, score FROM pr WHERE low > 1 OR season NOT IN (SELECT season FROM ot) UNION ALL SELECT season, clip_no, kind, start_s, score FROM ot WHERE o = 1)
SELECT *, CAST(row_number() OVER (PARTITION BY season ORDER BY CASE kind WHEN 'elite_save' THEN 0 WHEN 'goal' THEN 1 ELSE 2 END, score DESC, clip_no) AS int) AS pos FROM fin"""
query("sea7_pooled_agenda", sql("clips", SQL_WEEK))(lambda s, d: S.agenda(scored(s, d), 3, by=("season",), per_game=1))

SQL_REEL = """
bt AS (SELECT vid, season, game, start_s, arg_max(clip_no, {{'s': score, 'c': -clip_no}}) AS clip_no, arg_max(end_s, {{'s': score, 'c': -clip_no}}) AS end_s, max(score) AS score, arg_max(beaten_location, {{'s': score, 'c': -clip_no}}) AS spot FROM rl GROUP BY 1, 2, 3, 4),
q AS (SELECT *, row_number() OVER (PARTITION BY vid, season, game ORDER BY score DESC, clip_no) AS rn FROM bt),
w AS (SELECT DISTINCT vid, season, game, CAST(0 AS bigint) AS rn, CAST([] AS int[]) AS st, CAST(NULL AS bigint) AS clip_no FROM q
  UNION ALL SELECT w.vid, w.season, w.game, q.rn, CASE WHEN len(list_filter(w.st, lambda s: abs(s - q.start_s) <= 2)) > 0 THEN w.st ELSE list_append(w.st, q.start_s) END,
    CASE WHEN len(list_filter(w.st, lambda s: abs(s - q.start_s) <= 2)) > 0 THEN NULL ELSE q.clip_no END FROM w JOIN q ON q.vid = w.vid AND q.season = w.season AND q.game = w.game AND q.rn = w.rn + 1),
kp AS (SELECT q.*, row_number() OVER (PARTITION BY q.vid, q.season, q.game ORDER BY q.rn) AS gr FROM w JOIN q USING (vid, season, game, clip_no)),
rk AS (SELECT vid, season, game, clip_no, start_s, end_s - start_s AS len, score, spot, row_number() OVER (PARTITION BY vid, season ORDER BY turn, score DESC, clip_no) AS rank
  FROM (SELECT *, {turn} AS turn FROM kp WHERE gr <= {pg})),
tt AS (SELECT *, sum(len) OVER (PARTITION BY vid, season ORDER BY rank) AS total_len FROM rk WHERE rank <= {cap})
SELECT vid, season, game, clip_no, start_s, len, round(score, 6) AS score, CAST(rank AS int) AS rank, CAST(total_len AS bigint) AS total_len,
  CAST(row_number() OVER (PARTITION BY vid, season ORDER BY start_s, clip_no) AS int) AS shown{spot} FROM tt WHERE total_len <= {ml} OR rank = 1"""
SQL_SAVES = f"""
rl AS (SELECT *, 0.4::double * least(saves, 3) / 3 + 0.25::double * coalesce(({QA} + {QS}) / 2 / 3, 0) + 0.2::double * (position_confidence / 5::double) + 0.15::double * (coaching_confidence / 5::double) AS score
  FROM clips WHERE saves > 0 AND goals = 0 AND position_confidence >= 2),"""
D3 = "CASE depth_rank WHEN 'Base (B)' THEN 0.0::double WHEN 'Aggressive (A)' THEN 1.0 WHEN 'Conservative (C)' THEN 2.0 ELSE 3.0 END"
SQL_GOALS = f"""
rl AS (SELECT *, 0.5::double * (1 - coalesce({REBO}, 1.5) / 3) + 0.3::double * (({D3} + (3 - {QA}) + (3 - {QS})) / 9) + 0.2::double * (least(coalesce(position_confidence, 3), coaching_confidence) / 5::double) AS score FROM clips WHERE goals > 0),"""
query("sea12_saves_reel", sql("clips", SQL_SAVES + SQL_REEL.format(pg=3, cap=8, ml=90, turn="1", spot="")))(lambda s, d: r6(S.reel(C(s, d), "saves"), "score"))
query("sea12_goals_reel", sql("clips", SQL_GOALS + SQL_REEL.format(pg=10, cap=10, ml=180, turn="1", spot="")))(lambda s, d: r6(S.reel(C(s, d), "goals"), "score"))
TURN = "row_number() OVER (PARTITION BY vid, season, spot ORDER BY score DESC, clip_no)"
query("sea12_goals_reel_spread", sql("clips", SQL_GOALS + SQL_REEL.format(pg=10, cap=10, ml=180, turn=TURN, spot=", spot")))(lambda s, d: r6(S.reel(C(s, d), "goals", spread="beaten_location"), "score"))

# -- report card ----------------------------------------------------------------------------
_G = {
    "depth": ("CASE depth_rank WHEN 'Aggressive (A)' THEN 100.0::double WHEN 'Base (B)' THEN 85 WHEN 'Conservative (C)' THEN 65 WHEN 'Defensive (D)' THEN 45 END", "position_confidence"),
    "angle": ("CASE cover_angle_rank WHEN 'Excellent' THEN 100.0::double WHEN 'Good' THEN 80 WHEN 'Average' THEN 60 WHEN 'Poor' THEN 40 END", "position_confidence"),
    "squareness": ("CASE squareness_rank WHEN 'Excellent' THEN 100.0::double WHEN 'Good' THEN 80 WHEN 'Average' THEN 60 WHEN 'Poor' THEN 40 END", "position_confidence"),
    "rebound": ("CASE rebound_control_rank WHEN 'Killed (Elite)' THEN 100.0::double WHEN 'Steered to Low-Danger Zone' THEN 75 WHEN 'Uncontrolled into High-Danger Zone' THEN 40 WHEN 'Goal Allowed' THEN 10 END", "coaching_confidence"),
}


def _w(c):
    return f"greatest(least(coalesce({c}, 3), 5), 1) / 5::double"


SQL_GS = "\ngs AS (SELECT vid, season, game, month, " + ", ".join(
    f"sum({_w(c)} * ({e})) AS {p}_ws, sum(CASE WHEN ({e}) IS NOT NULL THEN {_w(c)} END) AS {p}_w" for p, (e, c) in _G.items()
) + ", CAST(sum(saves) AS bigint) AS saves, CAST(sum(goals) AS bigint) AS goals, CAST(sum(sog) AS bigint) AS sog, count(*) AS clips FROM clips GROUP BY ALL)"


def sql_pillars(src, by, out):
    cols = ", ".join(f"sum({p}_ws) / nullif(sum({p}_w), 0) AS {p}" for p in _G)
    return f""",
{out}0 AS (SELECT {by}, {cols}, CAST(sum(saves) AS bigint) AS saves, CAST(sum(goals) AS bigint) AS goals, CAST(sum(sog) AS bigint) AS sog, CAST(sum(clips) AS bigint) AS clips, sum(saves) / nullif(greatest(sum(saves) + sum(goals), sum(sog)), 0)::double AS save_pct FROM {src} GROUP BY {by}),
{out}1 AS (SELECT *, CASE WHEN save_pct IS NOT NULL THEN greatest(least((save_pct - 0.82::double) / (0.96::double - 0.82::double) * 100, 100), 0) END AS save_score FROM {out}0),
{out} AS (SELECT *, (coalesce(depth, 0) + coalesce(angle, 0) + coalesce(squareness, 0) + coalesce(rebound, 0) + coalesce(save_score, 0)) / nullif((depth IS NOT NULL)::int + (angle IS NOT NULL)::int + (squareness IS NOT NULL)::int + (rebound IS NOT NULL)::int + (save_score IS NOT NULL)::int, 0) AS overall FROM {out}1)"""


R5 = ", ".join(f"round({c}, 5) AS {c}" for c in ("depth", "angle", "squareness", "rebound", "save_pct", "save_score", "overall"))


def round5(df):
    for c in ("depth", "angle", "squareness", "rebound", "save_pct", "save_score", "overall"):
        df = df.withColumn(c, F.round(c, 5))
    return df


query("sea10_report_card", sql("clips", SQL_GS + sql_pillars("gs", "vid, season", "ps") + f"""
SELECT vid, season, {R5}, saves, goals, sog, clips,
  CASE WHEN overall >= 90 THEN 'A' WHEN overall >= 80 THEN 'B' WHEN overall >= 70 THEN 'C' WHEN overall >= 60 THEN 'D' ELSE 'F' END
  || CASE WHEN overall < 60 THEN '' WHEN CAST(floor(overall) AS int) % 10 >= 7 AND overall < 90 THEN '+' WHEN CAST(floor(overall) AS int) % 10 <= 3 AND overall < 100 THEN '-' ELSE '' END AS grade FROM ps"""))(
    lambda s, d: round5(S.report_card(C(s, d)))
)
SQL_TREND = SQL_GS + """,
gr AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY vid, season ORDER BY game DESC) <= CASE WHEN count(*) OVER (PARTITION BY vid, season) < 6 THEN greatest(count(*) OVER (PARTITION BY vid, season) // 2, 1) ELSE 3 END THEN 'recent' ELSE 'prior' END AS part FROM gs)""" + sql_pillars("gr", "vid, season, part", "pt") + """,
lg AS (""" + " UNION ALL ".join(f"SELECT vid, season, part, '{p}' AS pillar, {p} AS score FROM pt" for p in ("depth", "angle", "squareness", "rebound", "save_score", "overall")) + """),
tr AS (SELECT vid, season, pillar, max(score) FILTER (part = 'recent') AS recent, max(score) FILTER (part = 'prior') AS prior FROM lg GROUP BY 1, 2, 3)"""
query("sea11_trends", sql("clips", SQL_TREND + """
SELECT vid, season, pillar, round(recent, 5) AS recent, round(prior, 5) AS prior, round(recent - prior, 5) AS delta,
  CASE WHEN recent - prior IS NULL THEN 'not_enough' WHEN recent - prior >= 4 THEN 'improving' WHEN recent - prior <= -4 THEN 'declining' ELSE 'steady' END AS trend FROM tr"""))(
    lambda s, d: S.trends(C(s, d)).withColumns({c: F.round(c, 5) for c in ("recent", "prior", "delta")})
)
query("sea11_milestones", sql("clips", SQL_TREND + sql_pillars("gs", "vid, season, game", "pg") + """,
mo AS (SELECT vid, season, month, count(*) AS n, sum(saves) AS s, sum(goals) AS g FROM gs GROUP BY 1, 2, 3),
mb AS (SELECT *, row_number() OVER (PARTITION BY vid, season ORDER BY s / (s + g) DESC, month DESC) AS r FROM mo WHERE n >= 2 AND s + g > 0),
gi AS (SELECT *, row_number() OVER (PARTITION BY vid, season ORDER BY game) AS i FROM pg),
gk AS (SELECT *, i - row_number() OVER (PARTITION BY vid, season ORDER BY game) AS k FROM gi WHERE overall >= 80),
im AS (SELECT *, row_number() OVER (PARTITION BY vid, season ORDER BY recent - prior DESC, pillar DESC) AS r FROM tr WHERE pillar IN ('depth','angle','squareness','rebound') AND recent - prior >= 6)
SELECT vid, season, 'best_month' AS type, CAST(month AS varchar) AS label, round(s / (s + g), 5) AS value FROM mb WHERE r = 1
UNION ALL SELECT vid, season, 'wall_night', CAST(game AS varchar), sog::double FROM pg WHERE goals = 0 AND sog >= 15
UNION ALL SELECT vid, season, 'streak', CAST(min(game) AS varchar), count(*)::double FROM gk GROUP BY vid, season, k HAVING count(*) >= 3
UNION ALL SELECT vid, season, 'most_improved', pillar, round(recent - prior, 5) FROM im WHERE r = 1"""))(
    lambda s, d: S.milestones(C(s, d)).withColumn("value", F.round("value", 5))
)
query("sea14_digest", sql("clips", SQL_GS + """,
hf AS (SELECT *, ntile(2) OVER (PARTITION BY vid, season ORDER BY game) AS half FROM gs),
hs AS (SELECT vid, season, half, """ + ", ".join(f"sum({p}_ws) / nullif(sum({p}_w), 0) AS {p}" for p in _G) + """, sum(saves) / nullif(sum(sog), 0)::double AS sv, sum(sog) AS sog, count(*) AS games FROM hf GROUP BY 1, 2, 3),
x AS (SELECT vid, season, CAST(sum(games) AS bigint) AS games_played, sum(sog) AS sog, max(sv) FILTER (half = 1) AS from_pct, max(sv) FILTER (half = 2) AS to_pct, """ + ", ".join(
    f"max({p}) FILTER (half = 1) AS {p}_e, max({p}) FILTER (half = 2) AS {p}_l" for p in _G) + """ FROM hs GROUP BY 1, 2),
dl AS (""" + " UNION ALL ".join(f"SELECT vid, season, '{p}' AS p, {p}_l - {p}_e AS d, {p}_l AS l FROM x" for p in _G) + """),
up AS (SELECT vid, season, arg_max(p, {'d': d, 'p': p}) FILTER (d > 0) AS most_improved, arg_min(p, {'l': l, 'p': p}) FILTER (l IS NOT NULL) AS growth_area FROM dl GROUP BY 1, 2)
SELECT vid, season, games_played, round(from_pct, 5) AS from_pct, round(to_pct, 5) AS to_pct, round(to_pct - from_pct, 5) AS save_delta, most_improved, growth_area, games_played < 3 OR sog < 15 AS small_sample FROM x JOIN up USING (vid, season)"""))(
    lambda s, d: S.digest(C(s, d)).withColumns({c: F.round(c, 5) for c in ("from_pct", "to_pct", "save_delta")})
)
T3 = "CASE {c} WHEN 'Excellent' THEN 1.0::double WHEN 'Good' THEN 2.0 WHEN 'Average' THEN 3.0 WHEN 'Poor' THEN 3.0 END"
T3D = "CASE depth_rank WHEN 'Base (B)' THEN 1.0::double WHEN 'Aggressive (A)' THEN 2.0 ELSE 3.0 END"
BAND = "CASE WHEN {c} < 1.67 THEN 'Elite' WHEN {c} < 2.34 THEN 'Good' WHEN {c} IS NOT NULL THEN 'Needs work' END"
query("sea15_profile", sql("clips shots", SQL_DANGER + f""",
pr AS (SELECT vid, season, count(DISTINCT game) AS games, CAST(sum(shots) AS bigint) AS shots, CAST(sum(sog) AS bigint) AS sog, CAST(sum(saves) AS bigint) AS saves, CAST(sum(goals) AS bigint) AS goals, avg({T3D}) AS depth,
   avg({T3.format(c='cover_angle_rank')}) AS angle, avg({T3.format(c='squareness_rank')}) AS squareness FROM clips GROUP BY 1, 2),
sg AS (SELECT c.vid, c.season, c.game, sum(CASE WHEN d.outcome = 'save' THEN CASE d.danger WHEN 'high' THEN 3.0::double WHEN 'medium' THEN 2 ELSE 1 END ELSE 0 END) AS a, sum(CASE d.danger WHEN 'high' THEN 3.0::double WHEN 'medium' THEN 2 ELSE 1 END) AS b
   FROM dg d JOIN clips c USING (clip_no) WHERE d.outcome IN ('save','goal') GROUP BY 1, 2, 3),
ag AS (SELECT g.vid, g.season, bool_and(sg.b IS NOT NULL) AS ok, sum(a) AS a, sum(b) AS b FROM (SELECT DISTINCT vid, season, game FROM clips) g LEFT JOIN sg USING (vid, season, game) GROUP BY 1, 2)
SELECT vid, season, games, shots, sog, saves, goals, round(saves / nullif(sog, 0), 6) AS save_pct, {BAND.format(c='depth')} AS depth_band, {BAND.format(c='angle')} AS angle_band, {BAND.format(c='squareness')} AS squareness_band,
  CASE WHEN ok THEN round(a / b, 6) END AS danger_save_pct FROM pr JOIN ag USING (vid, season)"""))(
    lambda s, d: r6(
        S.profile(
            C(s, d),
            S.shot_danger(V.shots(s, d)).drop("vid").join(C(s, d).select("clip_no", "vid", "season", "game"), "clip_no"),
            ("vid", "season"),
        ),
        "save_pct", "danger_save_pct",
    ).select("vid", "season", "games", "shots", "sog", "saves", "goals", "save_pct", "depth_band", "angle_band", "squareness_band", "danger_save_pct")
)
