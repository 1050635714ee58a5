"""Source, sink-row, text and watchdog queries over text derived from the tables."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from .. import views as V
from ..blocks import shared_folder
from ..functions import labels as L, text as TX, timefmt as TF
from ..operators import records as R
from ..sources import readers as RD, sinks as K
from ..streaming import watchdog as WD
from ..views import sql
from .intervals import SQL_TRACE, traced
from .matching import SQL_P, preds, sql_tok
from .records import CONFS, DEPTHS, _arr, sql_conf, sql_enum
from .registry import query
from .series import SQL_CAND, SQL_FUSE, cands, fused

query("src1_parse_probs", sql("ev", "SELECT vid, t, value AS p FROM ev WHERE event_id % 7 NOT IN (0, 3)"))(
    lambda s, d: RD.parse_probs(
        V.ev(s, d).selectExpr("vid", "case event_id % 7 when 0 then 'x' else concat(t, '.0') end as c0", "case event_id % 7 when 3 then '' else cast(value as string) end as c1")
    )
)
query("src3_parse_features", sql("ev", """
SELECT vid, t, CASE WHEN event_id % 5 = 0 THEN 0.0 ELSE value END AS rms, CASE WHEN event_id % 4 = 0 THEN 0.0 ELSE value * 2 END AS zcr FROM ev WHERE event_id % 6 <> 5"""))(
    lambda s, d: RD.parse_features(
        V.ev(s, d).selectExpr(
            "vid", "if(event_id % 6 = 5, 'bad', cast(t as string)) as t", "if(event_id % 5 = 0, 'nan', cast(value as string)) as rms",
            "case when event_id % 8 = 0 then '' when event_id % 4 = 0 then 'None' else cast(value * 2 as string) end as zcr",
        ), ["rms", "zcr"],
    )
)
query("src4_parse_events", sql("gt", """
SELECT vid, idx, start_s::double AS start_s, end_s::double AS end_s, team, action, CASE WHEN idx % 3 = 0 THEN 1 ELSE half END AS half FROM gt WHERE idx % 8 NOT IN (1, 2)"""))(
    lambda s, d: RD.parse_events(
        V.gt(s, d).selectExpr(
            "vid", "idx", "if(idx % 8 = 1, 'n/a', cast(start_s as string)) as start", "cast(end_s as string) as end", "concat(' ', team, ' ') as team", "concat(action, ' ') as action",
            "case when idx % 8 = 2 then 'first' when idx % 3 = 0 then '' else cast(half as string) end as half",
        )
    )
)
query("src5_parse_segments", sql("win", """
SELECT vid, win_id, start_s::double AS start_s, end_s::double AS end_s, win_id % 2 = 0 AS threat, color FROM win WHERE win_id % 5 <> 4"""))(
    lambda s, d: RD.parse_segments(
        V.win(s, d).selectExpr(
            "win_id as vid",
            "concat(case win_id % 5 when 0 then '[' when 1 then ' [' when 4 then '[{' else '{\"segments\":[' end, to_json(struct(win_id % 2 = 0 as segmentHasThreat, color as threat_goalie_color, start_s as segment_start, end_s as segment_end)), "
            "case when win_id % 5 in (0, 1) then ']' when win_id % 5 = 4 then '' else ']}' end) as doc",
        )
    ).withColumnRenamed("vid", "win_id").join(V.win(s, d).select("win_id", "vid"), "win_id").select("vid", "win_id", "start_s", "end_s", "threat", "color")
)
query("src6_sidecar", sql("win games", "SELECT w.win_id, g.vid % 2 = 0 AS applied FROM win w LEFT JOIN games g ON g.vid = w.vid"))(
    lambda s, d: RD.with_sidecar(V.win(s, d).select("vid", "win_id"), V.games(s, d).selectExpr("vid", "vid % 2 = 0 as applied")).select("win_id", "applied")
)
query("src7_parse_games", sql("games", "SELECT CAST(vid AS varchar) AS vid, target_team, opponent_team, target_color, target_side, CAST(n_periods AS int) AS n_periods FROM games WHERE vid % 11 <> 10"))(
    lambda s, d: RD.parse_games(
        V.games(s, d).selectExpr(
            "concat(if(vid % 2 = 0, '[', ''), to_json(struct(vid as vID, target_team as targetGoalieTeamName, opponent_team as opponentGoalieTeamName, target_color as targetGoalieColor, target_side as targetStartSide, periods)), "
            "if(vid % 2 = 0, ']', '')) as j", "vid",
        ).selectExpr("if(vid % 11 = 10, 'oops', j) as doc")
    ).select("vid", "target_team", "opponent_team", "target_color", "target_side", F.size("periods").alias("n_periods"))
)
query("src8_parse_predictions", sql("win", "SELECT CAST(vid AS varchar) AS vid, start_s::double AS start_s, end_s::double AS end_s, CASE WHEN win_id % 3 = 0 THEN NULL ELSE 0.5::double END AS confidence FROM win WHERE win_id % 10 <> 9"))(
    lambda s, d: RD.parse_predictions(
        V.win(s, d).selectExpr("cast(vid as string) as vID", "if(win_id % 10 = 9, '?', cast(start_s as string)) as start_s", "concat(end_s, '.0') as end_s", "if(win_id % 3 = 0, '', '0.5') as confidence")
    ).select("vid", "start_s", "end_s", "confidence")
)
query("src9_parse_boxes", sql("", """
SELECT 'v_' || l_suppkey AS vid, CASE WHEN l_linenumber % 2 = 0 THEN 'pos' ELSE 'hardneg' END AS kind, CAST(l_orderkey AS int) AS t, l_linenumber AS line_no, l_linenumber % 4 AS cls, l_discount AS cx, l_tax AS w FROM lineitem WHERE l_partkey % 9 <> 0"""))(
    lambda s, d: RD.parse_boxes(
        V.table(s, d, "lineitem").selectExpr(
            "concat('v_', l_suppkey, '_', if(l_linenumber % 2 = 0, 'pos', 'hardneg'), '_', lpad(l_orderkey, 7, '0'), '.txt') as file_name", "l_linenumber as line_no",
            "concat(l_linenumber % 4, ' ', l_discount, '  0.5 ', l_tax, if(l_partkey % 9 = 0, '', ' 0.25')) as value",
        )
    ).select("vid", "kind", "t", "line_no", "cls", "cx", "w")
)
query("src10_parse_run_log", sql("ev", "SELECT CAST(vid AS varchar) AS vid, CAST(t AS int) AS shots, CASE WHEN event_id % 2 = 0 THEN CAST(event_id % 5 AS int) END AS delta_shots FROM ev WHERE event_id % 13 <> 0"))(
    lambda s, d: RD.parse_run_log(
        V.ev(s, d).selectExpr(
            "event_id", "to_json(struct('2024' as ts, cast(vid as string) as vID, struct(t as shots) as predicted, if(event_id % 2 = 0, struct(event_id % 5 as shots), null) as delta)) as j"
        ).selectExpr("if(event_id % 13 = 0, substr(j, 1, 20), j) as value")
    ).select("vid", F.col("predicted")["shots"].alias("shots"), F.col("delta")["shots"].alias("delta_shots"))
)
query("src11_parse_reports", sql("clips", """
SELECT clip_no, CAST(goals AS int) AS predicted_goals, CASE WHEN clip_no % 3 = 0 THEN NULL ELSE 0.25::double END AS goal_p, CAST(shots AS int) AS n_windows, sog / 10.0::double AS shot_e2e_r FROM clips"""))(
    lambda s, d: RD.parse_reports(
        V.clips(s, d).select(
            "clip_no",
            F.format_string(
                "REPORT %d\n  predicted goals   %d\n  windows compared: %d\n precision  %s  x\nEnd-to-end (P/R/F1):  P=0.5  R=%.1f F1=0.4\n",
                "clip_no", "goals", "shots", F.when(F.expr("clip_no % 3 = 0"), "—").otherwise("0.25"), F.col("sog") / 10,
            ).alias("value"),
        )
    ).select("clip_no", "predicted_goals", "goal_p", "n_windows", "shot_e2e_r")
)
query("src12_latest_report", sql("", """
SELECT CAST(o_custkey AS varchar) AS vid, 'report_' || arg_max(o_orderkey, {'d': o_orderdate, 'p': 'report_' || o_orderkey}) AS path FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1"""))(
    lambda s, d: RD.latest_report(
        V.table(s, d, "orders").selectExpr("concat('report_', o_orderkey) as path", "o_orderdate as mtime", "concat('game: ', o_custkey, '. all done') as value"),
        V.table(s, d, "customer").selectExpr("c_custkey as vid"),
    )
)
query("src13_paired_ids", sql("", "SELECT c_custkey AS vid FROM customer WHERE c_custkey % 5 <> 0 INTERSECT SELECT o_custkey FROM orders"))(
    lambda s, d: RD.paired_ids(
        V.table(s, d, "customer").selectExpr("concat('/v/', if(c_custkey % 5 = 0, 'x', ''), c_custkey, '.mp4') as path"),
        V.table(s, d, "orders").selectExpr("concat('/g/gt_', o_custkey, '.csv') as path"),
    )
)

# -- rows as written ---------------------------------------------------------------------
query("snk5_prob_rows", sql("probs", SQL_FUSE + " SELECT vid, t, printf('%.4f', p) AS shot_max_conf, CAST(p > 0.5 AS int) AS shot_n, '0.0' AS goal_max_conf FROM fused"))(
    lambda s, d: K.prob_rows(fused(s, d)).select("vid", "t", "shot_max_conf", "shot_n", "goal_max_conf")
)


# -- files written and read again ----------------------------------------------------------
def scratch(spark) -> str:
    return f"{shared_folder(spark).rstrip('/')}/files-{uuid4().hex}"


def _vid(pattern: str):
    return F.regexp_extract("_metadata.file_name", pattern, 1).cast("bigint").alias("vid")


def candidate_files(spark, sf):
    K.write_candidates(cands(spark, sf), path := scratch(spark))
    x = spark.read.option("header", True).schema("rank int, t_seconds double, t_mmss string, confidence double").csv(path)
    return x.select(_vid(r"^(.*)\.csv$"), "*")


def prediction_files(spark, sf):
    p = preds(spark, sf).selectExpr("vid", "start_s", "end_s", "start_s % 97 / 100.0D as confidence", "color as team")
    K.write_predictions(p, path := scratch(spark))
    return RD.read_predictions(spark, path)


def trace_files(spark, sf):
    K.write_tsv(traced(spark, sf).select("vid", "start_s", "end_s", "source_signals", "n_overlapping_raw"), path := scratch(spark))
    x = spark.read.option("header", True).option("sep", "\t").schema("vid bigint, start_s int, end_s int, source_signals string, n_overlapping_raw bigint").csv(path)
    return x.withColumn("source_signals", F.coalesce("source_signals", F.lit("")))


def prob_files(spark, sf):
    K.write_probs(fused(spark, sf), path := scratch(spark))
    return RD.read_probs(spark, path).select(F.col("vid").cast("bigint").alias("vid"), "t", "p")


def segment_files(spark, sf):
    K.write_segments(V.win(spark, sf).withColumn("threat", F.col("source") != "faceoff"), path := scratch(spark))
    return RD.read_segments(spark, path).select(F.col("vid").cast("bigint").alias("vid"), "start_s", "end_s", "threat", "color")


query("snk1_candidate_files", sql("probs", SQL_CAND + " SELECT vid, rank, t_seconds, t_mmss, confidence FROM cand"))(candidate_files)
query("snk2_segment_files", sql("win", "SELECT vid, start_s::double AS start_s, end_s::double AS end_s, source <> 'faceoff' AS threat, color FROM win"))(segment_files)
query("snk3_prediction_files", sql("probs", SQL_P + " SELECT CAST(vid AS varchar) AS vid, start_s::double AS start_s, end_s::double AS end_s, start_s % 97 / 100.0::double AS confidence, color AS team FROM pr"))(prediction_files)
query("snk4_trace_files", sql("probs win", SQL_TRACE + " SELECT vid, start_s, end_s, array_to_string(source_signals, '+') AS source_signals, n_overlapping_raw FROM tr"))(trace_files)
query("snk5_prob_files", sql("probs", SQL_FUSE + " SELECT vid, t, CAST(printf('%.4f', p) AS double) AS p FROM fused"))(prob_files)
query("sca18_parse_iso", sql("", """
SELECT o_orderkey, CASE o_orderkey % 5 WHEN 2 THEN epoch(o_orderdate)::bigint - 7200 WHEN 3 THEN epoch(o_orderdate)::bigint + 19800 WHEN 4 THEN NULL ELSE epoch(o_orderdate)::bigint END AS seconds FROM orders"""))(
    lambda s, d: V.table(s, d, "orders").selectExpr(
        "o_orderkey",
        "if(o_orderkey % 5 = 4, 'soon', concat(date_format(o_orderdate, \"yyyy-MM-dd'T'HH:mm:ss\"), element_at(array('', 'Z', '+02:00', '-05:30', ''), cast(o_orderkey % 5 + 1 as int)))) as txt",
    ).select("o_orderkey", F.unix_timestamp(TF.parse_iso_utc(F.col("txt"))).alias("seconds"))
)
query("sca21_ids", sql("", """
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 2 THEN 'a b' || o_orderkey WHEN 3 THEN 'x/..' ELSE 'v-' || o_orderkey || '.1' END AS bare, o_orderkey % 4 < 2 AS safe FROM orders"""))(
    lambda s, d: V.table(s, d, "orders").selectExpr(
        "o_orderkey", "case o_orderkey % 4 when 0 then concat('gt_v-', o_orderkey, '.1.json') when 1 then concat(' v-', o_orderkey, '.1 ') when 2 then concat('gt_a b', o_orderkey) else 'x/..' end as raw",
    ).select("o_orderkey", TX.bare_id(F.col("raw"), "gt_").alias("bare")).withColumn("safe", TX.is_safe_id(F.col("bare")))
)
query("snk2_segment_meta", sql("win", "SELECT vid, count(*) AS n_segments, 'fusion' AS method FROM win GROUP BY 1"))(
    lambda s, d: K.segment_meta(V.win(s, d), "fusion").select("vid", "n_segments", "method")
)
query("snk6_run_log_rows", sql("clips gt", """
p AS (SELECT vid, CAST(sum(sog) AS bigint) AS sog, CAST(sum(goals) AS bigint) AS goals FROM clips GROUP BY 1), t AS (SELECT vid, count(*) FILTER (action = 'Shots') AS sog, count(*) FILTER (action = 'Goals') AS goals FROM gt GROUP BY 1)
SELECT p.vid AS "vID", p.sog - t.sog AS d_sog, p.goals - t.goals AS d_goals FROM p LEFT JOIN t USING (vid)"""))(
    lambda s, d: K.run_log_rows(
        V.clips(s, d).groupBy("vid").agg(F.sum("sog").alias("sog"), F.sum("goals").alias("goals")),
        V.gt(s, d).groupBy("vid").agg(F.count_if(F.col("action") == "Shots").alias("sog"), F.count_if(F.col("action") == "Goals").alias("goals")),
    ).select("vID", F.col("delta.sog").alias("d_sog"), F.col("delta.goals").alias("d_goals"))
)
query("snk7_publishable", sql("clips ev", """
SELECT clip_no FROM clips WHERE vid IN (SELECT user_id FROM ev GROUP BY user_id HAVING bool_and(event_type <> 'error' OR value < 60))"""))(
    lambda s, d: K.publishable(V.clips(s, d), V.ev(s, d).selectExpr("user_id as vid", "event_type <> 'error' or value < 60 as ok")).select("clip_no")
)
query("agg29_game_document", sql("clips", "SELECT vid, 'summary' AS type, -1 AS pos FROM clips GROUP BY vid UNION ALL SELECT vid, 'windows', start_s FROM clips"))(
    lambda s, d: R.game_document(V.clips(s, d).selectExpr("vid", "start_s", "clip_no", "cast(null as string) as error")).select("vid", "type", "pos")
)

# -- table-level text and time jobs ----------------------------------------------------------
query("sca1_format_times", sql("", """
SELECT l_orderkey, lpad(CAST(floor(s) AS bigint) // 60 || '', 2, '0') || ':' || lpad(CAST(floor(s) AS bigint) % 60 || '', 2, '0') AS mmss, lpad(CAST(round_even(s, 0) AS bigint) // 60 || '', 2, '0') || ':' || lpad(CAST(round_even(s, 0) AS bigint) % 60 || '', 2, '0') AS mmss_r,
  lpad(CAST(round_even(s, 0) AS bigint) // 3600 || '', 2, '0') || ':' || lpad(CAST(round_even(s, 0) AS bigint) % 3600 // 60 || '', 2, '0') AS hhmm FROM (SELECT l_orderkey, l_quantity * 97.25 AS s FROM lineitem)"""))(
    lambda s, d: V.table(s, d, "lineitem").selectExpr("l_orderkey", "l_quantity * 97.25D as s").select(
        "l_orderkey", TF.fmt_mmss(F.col("s")).alias("mmss"), TF.fmt_mmss_rounded(F.col("s")).alias("mmss_r"), TF.fmt_hhmm(F.col("s")).alias("hhmm")
    )
)
query("sca2_parse_times", sql("", """
SELECT l_orderkey, CASE WHEN l_partkey % 5 = 0 THEN NULL WHEN l_linenumber * 12 >= 60 THEN NULL ELSE CAST(l_quantity AS int) * 60 + l_linenumber * 12 END AS secs FROM lineitem"""))(
    lambda s, d: V.table(s, d, "lineitem").selectExpr(
        "l_orderkey", "if(l_partkey % 5 = 0, 'soon', concat(' ', cast(l_quantity as int), ':', l_linenumber * 12)) as c"
    ).select("l_orderkey", TF.parse_mmss(F.col("c")).alias("secs"))
)
query("sca8_clean_enums", sql("", f"""
x AS (SELECT o_orderkey, ({_arr(DEPTHS)})[o_orderkey % 8 + 1] AS d, ({_arr(CONFS)})[o_orderkey % 10 + 1] AS c FROM orders), t AS (SELECT d, {sql_enum('d', 'depth')} AS v FROM (SELECT DISTINCT d FROM x))
SELECT o_orderkey, v AS depth, {sql_conf('c')} AS conf FROM x JOIN t USING (d)"""))(
    lambda s, d: V.table(s, d, "orders").selectExpr(
        "o_orderkey", f"element_at({DEPTHS}, cast(o_orderkey % 8 + 1 as int)) as d", f"replace(element_at({CONFS}, cast(o_orderkey % 10 + 1 as int)), '\"', '') as c"
    ).select("o_orderkey", L.clean_enum(F.col("d"), "depth").alias("depth"), L.normalize_conf(F.col("c")).alias("conf"))
)
query("sca3_color_tokens", sql("", f"SELECT doc_id, array_to_string({sql_tok('text')}, ',') AS colors FROM documents"))(
    lambda s, d: V.table(s, d, "documents").select("doc_id", F.array_join(TX.color_tokens(F.col("text")), ",").alias("colors"))
)
query("sca13_clip_ids", sql("clips", "SELECT clip_no, vid || '_' || start_s || '_' || end_s AS clip_id, CAST(vid AS varchar) AS back_vid, start_s AS back_start FROM clips"))(
    lambda s, d: V.clips(s, d).select("clip_no", TX.clip_id(F.col("vid"), F.col("start_s"), F.col("end_s")).alias("clip_id")).withColumns(
        dict(zip(("back_vid", "back_start"), TX.clip_parts(F.col("clip_id"))[:2]))
    )
)
# reply texts carry whole conversation texts, some cut off inside the summary
query("sca15_parse_summary", sql("", """
SELECT conv_id, turn, CASE (conv_id + turn) % 5 WHEN 4 THEN 'Summary generation failed: response could not be parsed.' ELSE text END AS summary, CASE WHEN (conv_id + turn) % 5 IN (0, 1) THEN '78%' ELSE 'N/A' END AS rating FROM conversations"""))(
    lambda s, d: summaries(s, d)
)


def summaries(spark, sf):
    c = V.table(spark, sf, "conversations").selectExpr("conv_id", "turn", "(conv_id + turn) % 5 as k", "to_json(struct(text as coaches_summary)) as j", "text")
    full = F.expr("concat(substr(j, 1, length(j) - 1), ',\"coaches_overall_rating\":\"78%\"}')")
    raw = (
        F.when(F.col("k") == 0, full).when(F.col("k") == 1, F.concat(F.lit("```json\n"), full, F.lit("\n```"))).when(F.col("k") == 2, F.col("j"))
        .when(F.col("k") == 3, F.expr("substr(j, 1, length(j) - 2)")).otherwise(F.lit("no reply"))
    )
    x = c.withColumn("raw", raw)
    summary, rate = L.parse_summary(F.col("raw"))
    return x.select("conv_id", "turn", summary.alias("summary"), rate.alias("rating"))


query("sca17_progress", sql("ev", "SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL ELSE CAST(round_even((event_id % 4 + least(t, 500) / 500.0::double) / 3 * 100, 0) AS int) END AS pct FROM ev"))(
    lambda s, d: V.ev(s, d).select("event_id", WD.progress_pct(F.expr("cast(event_id % 4 + 1 as int)"), F.col("t"), F.lit(500)).alias("pct"))
)
query("sca20_source_uri", sql("", """
SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'media' ELSE 'main' END AS bucket, CASE WHEN page_id % 3 = 0 THEN 'raw/' || page_id || '.mp4' ELSE 'full/full_' || page_id || '.mp4' END AS key FROM pages"""))(
    lambda s, d: V.table(s, d, "pages").selectExpr("page_id", "case page_id % 3 when 0 then concat('gs://media/raw/', page_id, '.mp4') when 1 then url else '' end as u").select(
        "page_id", F.coalesce(TX.split_uri(F.col("u"))[0], F.lit("main")).alias("bucket"),
        F.coalesce(TX.split_uri(F.col("u"))[1], F.concat(F.lit("full/full_"), F.col("page_id"), F.lit(".mp4"))).alias("key"),
    )
)
SQL_STATUS = "st AS (SELECT user_id AS vid, max(ts) AS updated, arg_max(CASE WHEN event_type IN ('error','view') THEN 'Processing (40%)' ELSE 'Done' END, ts) AS status FROM ev GROUP BY 1), nw AS (SELECT max(ts) AS now FROM ev)"


def statuses(spark, sf):
    e = V.ev(spark, sf)
    last = WD.latest_status(e.selectExpr("user_id as vid", "ts as updated", "if(event_type in ('error', 'view'), 'Processing (40%)', 'Done') as status"))
    now = e.agg(F.max("ts").alias("now")).withColumn("__one", F.lit(1))
    return WD.stale_status(last.withColumn("__one", F.lit(1)).join(F.broadcast(now), "__one").drop("__one"), F.col("now")).drop("now").withColumn("updated", F.unix_micros("updated"))


query("str1_stale_status", sql("ev", SQL_STATUS + """
SELECT vid, epoch_us(updated) AS updated, status LIKE 'Processing%' AND epoch(date_trunc('second', now)) - epoch(date_trunc('second', updated)) > 2700 AS stalled,
  CASE WHEN status LIKE 'Processing%' AND epoch(date_trunc('second', now)) - epoch(date_trunc('second', updated)) > 2700 THEN 'Failed: stalled (no update for ' || CAST(floor((epoch(date_trunc('second', now)) - epoch(date_trunc('second', updated))) / 60) AS bigint) || ' min)' ELSE status END AS status FROM st, nw"""))(statuses)
