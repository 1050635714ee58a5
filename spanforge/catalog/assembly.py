"""Attribution and segment assembly queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import views as V
from ..blocks import cut
from ..operators import attribution as A
from ..plans import assembly as P
from ..views import BLK, sql
from .intervals import SQL_ADJ, merged
from .intervals import SQL_CLASS
from .registry import query

CFG = P.AssemblyConfig(min_threat=3, max_threat=20, min_keep=2, block=BLK)

SQL_MS = """
sp AS (SELECT DISTINCT vid, start_s, end_s FROM win WHERE end_s > start_s),
mm AS (SELECT p.vid, p.start_s, p.end_s, avg(motion_left) AS ml, avg(motion_right) AS mr FROM sp p JOIN sig s
       ON s.vid = p.vid AND s.t >= greatest(p.start_s - 10, 0) AND s.t < p.end_s GROUP BY 1, 2, 3),
mw AS (SELECT w.*, coalesce(ml, 0) AS ml, coalesce(mr, 0) AS mr FROM win w LEFT JOIN mm USING (vid, start_s, end_s)),
mx AS (SELECT *, CASE WHEN abs(mr - ml) >= 0.5 THEN greatest(ml, mr) / greatest(least(ml, mr), 1e-6) ELSE 1.0 END AS ratio FROM mw),
ms AS (SELECT *, CASE WHEN abs(mr - ml) >= 0.5 AND ratio >= 1.15 THEN CASE WHEN mr > ml THEN 'right' ELSE 'left' END ELSE 'ambiguous' END AS aside FROM mx)"""
query("jon1_motion_side", sql("win sig", SQL_MS + " SELECT vid, win_id, round(ml, 8) AS mean_left, round(mr, 8) AS mean_right, round(ratio, 4) AS motion_ratio, aside AS attacked_side FROM ms"))(
    lambda s, d: A.motion_side(V.win(s, d), V.sig(s, d), block=BLK).select(
        "vid", "win_id", F.round("mean_left", 8).alias("mean_left"), F.round("mean_right", 8).alias("mean_right"),
        F.round("motion_ratio", 4).alias("motion_ratio"), "attacked_side",
    )
)
SQL_PS = """
gg AS (SELECT *, lower(trim(target_side)) AS ts, lower(trim(opponent_side)) AS os FROM games),
pp AS (SELECT p.vid, p.p_start, ts, os, row_number() OVER (PARTITION BY p.vid ORDER BY p_start) AS i FROM periods p JOIN gg USING (vid) WHERE ts <> os),
psd AS (SELECT vid, p_start AS start_t, CAST(i AS int) AS num, CASE WHEN i % 2 = 1 THEN ts ELSE os END AS target_side, CASE WHEN i % 2 = 1 THEN os ELSE ts END AS opponent_side FROM pp
        UNION ALL SELECT vid, 0, 0, ts, os FROM pp WHERE i = 1 AND p_start > 0)"""
query("jon3_period_sides", sql("games periods", SQL_PS + " SELECT * FROM psd"))(lambda s, d: A.period_sides(V.games(s, d)))


def sql_light(c):
    light, dark = "['white','light','yellow','gold','silver','cream']", "['black','dark','navy','red','green','blue','maroon','purple','brown','grey','gray']"
    return f"(len(list_filter({light}, lambda k: contains(lower({c}), k))) >= len(list_filter({dark}, lambda k: contains(lower({c}), k))))"


T, O = "target_color", "opponent_color"
SQL_SIDES = SQL_PS + f""",
gc AS (SELECT vid, {T}, {O}, ts, os,
  CASE WHEN {sql_light(T)} AND NOT {sql_light(O)} THEN {T} WHEN {sql_light(O)} AND NOT {sql_light(T)} THEN {O} ELSE least({T}, {O}) END AS ca,
  CASE WHEN {sql_light(T)} AND NOT {sql_light(O)} THEN {O} WHEN {sql_light(O)} AND NOT {sql_light(T)} THEN {T} ELSE greatest({T}, {O}) END AS cb FROM gg)"""


def sql_side_at(src, out, extra=""):
    """Attach sides in force at the start of every row of ``src``."""
    return f"""
{out} AS (SELECT x.*, g.target_color AS tc, g.opponent_color AS oc, g.ca, g.cb,
   coalesce(arg_max(p.target_side, p.start_t * 10 + p.num), any_value(g.ts)) AS tside, coalesce(arg_max(p.opponent_side, p.start_t * 10 + p.num), any_value(g.os)) AS oside
  FROM {src} x LEFT JOIN gc g ON g.vid = x.vid LEFT JOIN psd p ON p.vid = x.vid AND p.start_t <= x.start_s GROUP BY ALL)"""


query("jon2_side_at", sql("win games periods", SQL_CLASS + "," + SQL_SIDES + "," + sql_side_at("mcl", "sa") + """
SELECT vid, start_s, end_s, threat, color, CASE WHEN threat AND color IS NOT NULL THEN CASE WHEN color = oc THEN oside WHEN color = tc THEN tside END END AS side FROM sa"""))(
    lambda s, d: A.apply_sides(merged(s, d), V.games(s, d))
)
def sql_half_even(c, digits, keep):
    """Non-negative ``c``, read to ``digits`` decimals, to ``keep`` of them, half to even, in whole numbers."""
    i, u = f"CAST(round({c} * 1e{digits}) AS bigint)", 10 ** (digits - keep)
    return f"({i} // {u} + CASE WHEN {i} % {u} > {u // 2} OR ({i} % {u} = {u // 2} AND {i} // {u} % 2 = 1) THEN 1 ELSE 0 END) / 1e{keep}"


SQL_ATTR = SQL_MS + "," + SQL_SIDES + ",\nmp AS (SELECT * REPLACE (least(end_s, dur)::int AS end_s) FROM ms LEFT JOIN (SELECT vid, max(t) + 1 AS dur FROM sig GROUP BY vid) USING (vid) WHERE least(end_s, dur) > start_s)," + sql_side_at("mp", "sa") + """,
dec AS (SELECT *, CASE WHEN aside <> 'ambiguous' THEN aside WHEN mr > ml THEN 'right' WHEN ml > mr THEN 'left' END AS dside,
   CASE WHEN aside <> 'ambiguous' THEN 'motion' WHEN mr <> ml THEN 'fallback_motion_edge' END AS dsrc FROM sa),
dc AS (SELECT *, CASE WHEN dside IS NOT NULL THEN CASE WHEN (CASE WHEN ca = oc THEN oside WHEN ca = tc THEN tside END) = dside THEN ca
   WHEN (CASE WHEN cb = oc THEN oside WHEN cb = tc THEN tside END) = dside THEN cb ELSE ca END END AS dcol FROM dec),
pv AS (SELECT *, last_value(dcol IGNORE NULLS) OVER w AS pc, last_value(dside IGNORE NULLS) OVER w AS psd_, count(*) OVER w AS n FROM dc
   WINDOW w AS (PARTITION BY vid ORDER BY win_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
fc AS (SELECT *, coalesce(dcol, pc, ca) AS col FROM pv),
att AS (SELECT vid, win_id, start_s, end_s, source, col AS color, coalesce(dside, CASE WHEN col = oc THEN oside WHEN col = tc THEN tside END, psd_, 'left') AS side,
   """ + sql_half_even("ml", 8, 3) + " AS motion_left, " + sql_half_even("mr", 8, 3) + " AS motion_right, " + sql_half_even("ratio", 6, 2) + """ AS motion_ratio,
   coalesce(dsrc, CASE WHEN n = 0 THEN 'fallback_default_a' ELSE 'fallback_inherit_prev' END) AS attribution_src FROM fc)"""
query("jon4_attribute", sql("win sig games periods", SQL_ATTR + " SELECT * FROM att"))(
    lambda s, d: A.attribute(V.win(s, d), cut(V.sig(s, d)), V.games(s, d), block=BLK).select(
        "vid", "win_id", "start_s", "end_s", "source", "color", "side", "motion_left", "motion_right", "motion_ratio", "attribution_src"
    )
)
query("agg23_side_vote", sql("det", """
f AS (SELECT vid, t, arg_max(side, {'c': conf, 'b': -box_no}) FILTER (cls = 'goal') AS g, arg_max(side, {'c': conf, 'b': -box_no}) FILTER (cls = 'goalie') AS k FROM (
  SELECT *, CASE WHEN (x1 + x2) / 2 < 260 THEN 'left' ELSE 'right' END AS side FROM (SELECT * REPLACE (round(conf, 6) AS conf) FROM det)) GROUP BY 1, 2),
fk AS (SELECT *, CASE WHEN g = k THEN 'cooccur' WHEN k IS NOT NULL AND g IS NULL THEN 'goalie_only' WHEN g IS NOT NULL AND k IS NULL THEN 'goal_only' END AS kind, coalesce(k, g) AS vote FROM f),
w AS (SELECT DISTINCT vid, CAST(t // 50 * 50 AS int) AS start_s, CAST(t // 50 * 50 + 50 AS int) AS end_s FROM det),
x AS (SELECT w.vid, w.start_s, w.end_s, count(*) AS n_frames, count(*) FILTER (kind = 'cooccur') AS nc, count(*) FILTER (kind = 'cooccur' AND vote = 'left') AS lc,
   count(*) FILTER (kind = 'goalie_only') AS nk, count(*) FILTER (kind = 'goalie_only' AND vote = 'left') AS lk, count(*) FILTER (kind = 'goal_only') AS ng, count(*) FILTER (kind = 'goal_only' AND vote = 'left') AS lg
  FROM w JOIN fk ON fk.vid = w.vid AND fk.t >= w.start_s AND fk.t < w.end_s GROUP BY 1, 2, 3),
y AS (SELECT *, CASE WHEN nc >= 2 THEN CASE WHEN lc / nc >= 0.66 THEN 'left' WHEN (nc - lc) / nc >= 0.66 THEN 'right' END END AS wc,
   CASE WHEN nk >= 2 THEN CASE WHEN lk / nk >= 0.66 THEN 'left' WHEN (nk - lk) / nk >= 0.66 THEN 'right' END END AS wk,
   CASE WHEN ng >= 2 THEN CASE WHEN lg / ng >= 0.66 THEN 'left' WHEN (ng - lg) / ng >= 0.66 THEN 'right' END END AS wg FROM x)
SELECT vid, start_s, end_s, n_frames, nc AS n_cooccur, nk AS n_goalie_only, ng AS n_goal_only, coalesce(wc, wk, wg) AS net_side,
   CASE WHEN wc IS NOT NULL THEN 'cooccur' WHEN wk IS NOT NULL THEN 'goalie_only' WHEN wg IS NOT NULL THEN 'goal_only' ELSE 'none' END AS net_label FROM y"""))(
    lambda s, d: A.side_vote(
        V.det(s, d).selectExpr("vid", "cast(t div 50 * 50 as int) as start_s", "cast(t div 50 * 50 + 50 as int) as end_s"),
        V.det(s, d).withColumn("conf", F.round("conf", 6)), 520.0,
    )
)


def sql_fold_classified(src, out):
    body = SQL_CLASS[SQL_CLASS.index("mc AS (") :].replace("FROM cs)", f"FROM {src}o)").replace("JOIN cs x", f"JOIN {src}o x")
    for a, b in (("mc AS (", f"{src}m AS ("), ("FROM mc m", f"FROM {src}m m"), ("FROM mc GROUP", f"FROM {src}m GROUP"), ("ml AS (", f"{src}l AS ("), ("FROM ml)", f"FROM {src}l)"), ("mcl AS (", f"{out} AS (")):
        body = body.replace(a, b)
    return f"\n{src}o AS (SELECT *, row_number() OVER (PARTITION BY vid ORDER BY start_s, end_s, ord) AS rn FROM {src}),\n" + body


SQL_ASM = SQL_ATTR + """,
dur AS (SELECT vid, max(t) + 1 AS dur FROM sig GROUP BY vid),
a1 AS (SELECT vid, start_s, end_s, color, win_id AS ord FROM att a WHERE end_s - start_s >= 3 AND (end_s > 20 OR EXISTS (
   SELECT 1 FROM sig s WHERE s.vid = a.vid AND s.faceoff >= 0.8 AND s.t BETWEEN a.start_s AND a.end_s))),""" + sql_fold_classified("a1", "a2") + """,
k AS (SELECT a2.vid, start_s AS raw_s, greatest(least(start_s, dur), 0) AS s, greatest(least(end_s, dur), 0) AS e, threat, color, dur FROM a2 JOIN dur USING (vid)),
kk AS (SELECT *, row_number() OVER (PARTITION BY vid ORDER BY raw_s) AS rn FROM k WHERE e > s),
a3 AS (SELECT vid, CAST(s AS int) AS start_s, CAST(e AS int) AS end_s, threat, color FROM kk
   UNION ALL SELECT vid, 0, CAST(min(raw_s) AS int), false, NULL FROM k GROUP BY vid HAVING min(raw_s) > 0
   UNION ALL SELECT vid, CAST(arg_max(e, rn) AS int), CAST(any_value(dur) AS int), false, NULL FROM kk GROUP BY vid HAVING arg_max(e, rn) < any_value(dur)
   UNION ALL SELECT vid, 0, CAST(dur AS int), false, NULL FROM dur WHERE vid NOT IN (SELECT vid FROM k)),""" + SQL_ADJ.format(src="a3", out="a4", cap=20) + """,
a5 AS (SELECT vid, CAST(s AS int) AS start_s, CASE WHEN long THEN CAST(least(s + 20, end_s) AS int) ELSE end_s END AS end_s, threat, color FROM (
  SELECT *, threat AND end_s - start_s > 20 AS long, unnest(CASE WHEN threat AND end_s - start_s > 20 THEN CAST(range(start_s, end_s, 20) AS int[]) ELSE [start_s] END) AS s FROM a4)),
a6 AS (SELECT vid, start_s, end_s, threat AND end_s - start_s >= 2 AS threat, CASE WHEN threat AND end_s - start_s >= 2 THEN color END AS color FROM a5),""" + SQL_ADJ.format(src="a6", out="a7", cap=20) + """,
a8 AS (SELECT m.vid, greatest(start_s, p_start) AS start_s, least(end_s, p_end) AS end_s, threat, color FROM a7 m JOIN periods p ON p.vid = m.vid AND m.end_s > p_start AND m.start_s < p_end
   UNION ALL SELECT vid, start_s, end_s, threat, color FROM a7 WHERE vid NOT IN (SELECT vid FROM periods)),""" + sql_side_at("a8", "a9") + """,
asm AS (SELECT vid, start_s, end_s, threat, color, CASE WHEN threat AND color IS NOT NULL THEN CASE WHEN color = oc THEN oside WHEN color = tc THEN tside END END AS side, tc FROM a9)"""


def assembled(spark, sf):
    return P.assemble(V.win(spark, sf), cut(V.sig(spark, sf)), V.games(spark, sf), CFG)


query("int17_assemble", sql("win sig games periods", SQL_ASM + " SELECT vid, start_s, end_s, threat, color, side FROM asm WHERE threat AND color = tc"))(assembled)
query("agg28_run_meta", sql("win sig games periods", SQL_ASM + """
SELECT vid, count(*) AS total_segments, count(*) FILTER (threat) AS threat_segments, count(*) FILTER (NOT threat) AS no_threat_segments,
  CAST(coalesce(sum(end_s - start_s) FILTER (color = 'White'), 0) AS bigint) AS white_s, CAST(coalesce(sum(end_s - start_s) FILTER (color = 'Navy Blue'), 0) AS bigint) AS navy_s FROM asm GROUP BY vid"""))(
    lambda s, d: P.run_meta(
        P.assemble(V.win(s, d), cut(V.sig(s, d)), V.games(s, d), P.AssemblyConfig(min_threat=3, max_threat=20, min_keep=2, block=BLK, target_only=False))
    ).select(
        "vid", "total_segments", "threat_segments", "no_threat_segments",
        F.coalesce(F.col("threat_duration_by_color")["White"], F.lit(0)).alias("white_s"),
        F.coalesce(F.col("threat_duration_by_color")["Navy Blue"], F.lit(0)).alias("navy_s"),
    )
)
