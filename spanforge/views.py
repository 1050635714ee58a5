"""Domain views over the given tables, in Spark and in SQL for the checks.

``vid`` groups fifteen users into one recording and ``t`` counts whole hours
since 2024-01-01, which plays the part of the second on a timeline.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .functions.stats import mean_in_order

#: block length used by the registered queries: timelines are 720 slots long
BLK = 240


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf}/{name}.parquet")


def ev(spark, sf):
    return table(spark, sf, "events").selectExpr(
        "event_id",
        "cast(ts as timestamp) as ts",
        "user_id",
        "event_type",
        "value",
        "props",
        "user_id div 15 as vid",
        "cast(floor((unix_micros(cast(ts as timestamp))/1e6 - 1704067200)/3600) as int) as t",
    )


def probs(spark, sf):
    return (
        ev(spark, sf)
        .withColumn("channel", F.when(F.col("event_type").isin("purchase", "signup"), "b").otherwise("a"))
        .groupBy("vid", "channel", "t")
        .agg(F.max_by(F.least(F.col("value") / 100, F.lit(1.0)), "event_id").alias("p"))
    )


def gt(spark, sf):
    """``idx`` is the event id: same order as a row number, no sort needed."""
    return (
        ev(spark, sf)
        .filter(F.col("event_type").isin("purchase", "signup", "error"))
        .selectExpr(
            "vid",
            "event_id as idx",
            "t as start_s",
            "t + 2 as end_s",
            "concat('Team ', user_id % 2, ' Club') as team",
            "case event_type when 'purchase' then 'Shots' when 'signup' then 'Goals' else 'OZ play' end as action",
            "cast(1 + t div 240 as int) as half",
        )
    )


def win(spark, sf):
    return (
        ev(spark, sf)
        .filter(F.col("event_type").isin("view", "click", "error"))
        .selectExpr(
            "vid",
            "event_id as win_id",
            "t as start_s",
            "cast(t + 1 + event_id % 9 as int) as end_s",
            "case event_type when 'view' then 'motion' when 'click' then 'motion_auto_close' else 'faceoff' end as source",
            "case when user_id % 2 = 0 then 'White' else 'Navy Blue' end as color",
        )
    )


def sig(spark, sf):
    """``faceoff`` is 0.9 where the second holds an error event, else 0.1; means add up in event order."""
    return (
        ev(spark, sf)
        .groupBy("vid", "t")
        .agg(
            (mean_in_order("value", "event_id") / 15).alias("motion"),
            mean_in_order(F.when(F.expr("user_id % 2 = 0"), F.col("value")), "event_id").alias("motion_left"),
            mean_in_order(F.when(F.expr("user_id % 2 = 1"), F.col("value")), "event_id").alias("motion_right"),
            (F.max("value") / 500).alias("activity"),
            F.when(F.count("*") > 2, 1.0).otherwise(0.0).alias("celeb"),
            F.expr("case when max(event_id) % 2 = 0 then 'left' else 'right' end").alias("celeb_side"),
            F.max(F.when(F.col("event_type") == "error", 0.9).otherwise(0.1)).alias("faceoff"),
        )
        .withColumn("motion_left", F.coalesce("motion_left", F.lit(0.0)))
        .withColumn("motion_right", F.coalesce("motion_right", F.lit(0.0)))
    )


def whistles(spark, sf):
    """Point events: one at every signup that carries a value above 20."""
    return (
        ev(spark, sf)
        .filter("event_type = 'signup' and value > 20")
        .selectExpr("vid", "cast(t + 0.5 as double) as t")
        .distinct()
    )


def det(spark, sf):
    return table(spark, sf, "lineitem").selectExpr(
        "l_suppkey % 10 as vid",
        "cast(l_orderkey as int) as t",
        "l_linenumber * 10000000L + l_partkey as box_no",
        "case l_linenumber % 4 when 0 then 'puck' when 1 then 'goal' when 2 then 'goalie' else "
        "if(l_linenumber = 7, element_at(array('centriod', 'faceoff', 'referee', 'player'), cast(l_partkey % 4 + 1 as int)), 'player') end as cls",
        "l_discount * 10 as conf",
        "l_quantity * 10 as x1",
        "l_tax * 1000 as y1",
        "l_quantity * 10 + 20 + l_linenumber as x2",
        "l_tax * 1000 + 30 as y2",
    )


def calls(spark, sf):
    """Several analysis calls per segment; duplicates keep the cheapest part."""
    return (
        table(spark, sf, "lineitem")
        .groupBy(F.col("l_orderkey").alias("seg_id"), F.col("l_linenumber").alias("call_no"))
        .agg(
            F.min(F.expr("cast(floor(l_quantity) as int) % 8")).alias("shots"),
            F.min(F.expr("cast(floor(l_quantity) as int) % 5")).alias("sog"),
            F.max(F.expr("if(l_returnflag = 'R', 1, 0)")).alias("goals"),
        )
    )


def games(spark, sf):
    """One configuration row per customer: colours, sides and three periods."""
    c, n = table(spark, sf, "customer"), table(spark, sf, "nation")
    return (
        c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey)
        .selectExpr(
            "c_custkey as vid",
            "case c_custkey % 4 when 0 then 'Team 0 Club' when 1 then 'TEAM 1 club' when 2 then 'Team 0 Club. 19U' "
            "else concat('Club ', n_name) end as target_team",
            "case c_custkey % 4 when 0 then 'Team 1 Club 19U' when 1 then 'Team 0 Club' when 2 then 'team 1 club' "
            "else concat(c_mktsegment, ' Club') end as opponent_team",
            "case when c_custkey % 2 = 0 then 'White' else 'Navy Blue' end as target_color",
            "case when c_custkey % 7 = 0 then (case when c_custkey % 2 = 0 then 'White' else 'Navy Blue' end) "
            "when c_custkey % 2 = 0 then 'Navy Blue' else 'White' end as opponent_color",
            "case when c_custkey % 3 = 0 then 'Left' else 'right' end as target_side",
            "case when c_custkey % 3 = 0 then 'right' else 'left' end as opponent_side",
            "2023 + c_custkey % 3 as season",
            "case when c_custkey % 5 = 4 then cast(array() as array<struct<num:int,start:int,end:int>>) else "
            "transform(sequence(0, 2), i -> named_struct('num', i + 1, 'start', i * 240 + 5, 'end', i * 240 + 230)) end as periods",
        )
    )


def runlog(spark, sf):
    return ev(spark, sf).selectExpr(
        "vid", "ts", "event_id", "event_type as field", "cast(floor(value) as int) % 7 - 3 as delta"
    )


def reviews(spark, sf):
    return (
        ev(spark, sf)
        .filter(F.col("event_type").isin("purchase", "error", "signup"))
        .selectExpr(
            "event_id % 500 as clip_id",
            "unix_micros(ts) as ts",
            "event_id as pos",
            "case event_type when 'purchase' then 'Accurate' when 'error' then 'Correction' else 'Comment' end as type",
        )
    )


def clips(spark, sf):
    """Finished clip records: orders are clips, their line items the shots."""
    o = table(spark, sf, "orders")
    li = (
        table(spark, sf, "lineitem")
        .groupBy("l_orderkey")
        .agg(
            F.count("*").alias("shots"),
            F.sum(F.expr("if(l_linestatus = 'F', 1, 0)")).alias("sog_raw"),
            F.sum(F.expr("if(l_returnflag = 'R' and l_linestatus = 'F', 1, 0)")).alias("goals"),
            F.max("l_linenumber").alias("max_line"),
        )
    )
    return (
        o.join(li, o.o_orderkey == li.l_orderkey)
        .selectExpr(
            "o_custkey % 50 as vid",
            "o_orderkey as clip_no",
            "cast(o_orderdate as timestamp) as game_ts",
            "to_date(o_orderdate) as game_date",
            "cast(o_orderkey % 3600 as int) as start_s",
            "cast(o_orderkey % 3600 + 8 + o_orderkey % 23 as int) as end_s",
            "shots",
            "sog_raw as sog",
            "sog_raw - goals as saves",
            "goals",
            "year(o_orderdate) as season",
            "year(o_orderdate) * 1000 + month(o_orderdate) * 10 + if(day(o_orderdate) > 15, 1, 0) as game",
            "year(o_orderdate) * 100 + month(o_orderdate) as month",
            "o_orderkey % 3 as rebounds",
            "element_at(array('Base (B)', 'Aggressive (A)', 'Conservative (C)', 'Defensive (D)'), cast(o_orderkey % 4 + 1 as int)) as depth_rank",
            "element_at(array('Excellent', 'Good', 'Average', 'Poor'), cast(o_orderkey div 4 % 4 + 1 as int)) as cover_angle_rank",
            "element_at(array('Poor', 'Good', 'Excellent', 'Average'), cast(o_orderkey div 3 % 4 + 1 as int)) as squareness_rank",
            "element_at(array('Killed (Elite)', 'Goal Allowed', 'Steered to Low-Danger Zone', 'Not Applicable', 'Uncontrolled into High-Danger Zone'), cast(o_orderkey div 5 % 5 + 1 as int)) as rebound_control_rank",
            "cast(1 + o_orderkey % 5 as int) as coaching_confidence",
            "if(o_orderkey % 6 = 5, null, cast(1 + o_orderkey div 2 % 5 as int)) as position_confidence",
            "if(o_orderkey % 4 = 1, null, (o_orderkey % 11) / 10D) as beaten_confidence",
            "if(o_orderkey % 9 = 0, 1, 0) as n_caveats",
            "case o_orderkey % 5 when 0 then 'unknown' when 1 then 'left' when 2 then 'right' when 3 then 'left' else 'right' end as side",
            "element_at(array('five_hole', 'glove_high', 'blocker_low', 'unknown', 'glove_low', 'blocker_high', 'body_other'), cast(o_orderkey % 7 + 1 as int)) as beaten_location",
            "element_at(array('slot', 'point', 'left circle', 'right circle', 'crease'), cast(max_line % 5 + 1 as int)) as shot_location",
            "element_at(array('wrist', 'slap', 'deflection', 'one-timer'), cast(o_orderkey % 4 + 1 as int)) as release",
            "concat('Shot from ', o_orderpriority, if(o_orderkey % 8 = 0, ' on a breakaway', ''), if(o_orderkey % 11 = 0, ' with rebound', '')) as cue_text",
        )
    )


def shots(spark, sf):
    """Shots inside clips: one per line item."""
    return table(spark, sf, "lineitem").selectExpr(
        "l_orderkey as clip_no", "l_orderkey % 50 as vid", "l_linenumber * 10000000L + l_partkey as shot_no",
        "element_at(array('slot', 'in close', 'left circle', 'point', 'behind net', 'right wing', 'neutral zone'), cast(l_partkey % 7 + 1 as int)) as location",
        "element_at(array('wrist', 'one-timer', 'slap', 'redirect-tip', 'backhand'), cast(l_suppkey % 5 + 1 as int)) as release",
        "case l_returnflag when 'R' then 'goal' when 'A' then 'save' else 'miss' end as outcome", "l_orderkey % 3 as rebounds",
        "if(l_orderkey % 8 = 0, 'Odd-man RUSH against', 'set play') as text",
        "if(l_orderkey % 2 = 0, 'left', 'right') as side", "cast(l_orderkey % 3600 as int) as start_s",
    )


# The same views for the SQL engine that checks results.
SQL_VIEWS = {
    "ev": """
  SELECT event_id, ts, user_id, event_type, value, props, user_id // 15 AS vid,
         CAST(floor((epoch(ts) - 1704067200) / 3600) AS int) AS t FROM events""",
    "probs": """
  SELECT vid, CASE WHEN event_type IN ('purchase','signup') THEN 'b' ELSE 'a' END AS channel, t,
         arg_max(least(value / 100, 1.0), event_id) AS p FROM ev GROUP BY ALL""",
    "gt": """
  SELECT vid, event_id AS idx, t AS start_s, t + 2 AS end_s,
         'Team ' || (user_id % 2) || ' Club' AS team,
         CASE event_type WHEN 'purchase' THEN 'Shots' WHEN 'signup' THEN 'Goals' ELSE 'OZ play' END AS action,
         CAST(1 + t // 240 AS int) AS half
  FROM ev WHERE event_type IN ('purchase','signup','error')""",
    "win": """
  SELECT vid, event_id AS win_id, t AS start_s, CAST(t + 1 + event_id % 9 AS int) AS end_s,
         CASE event_type WHEN 'view' THEN 'motion' WHEN 'click' THEN 'motion_auto_close' ELSE 'faceoff' END AS source,
         CASE WHEN user_id % 2 = 0 THEN 'White' ELSE 'Navy Blue' END AS color
  FROM ev WHERE event_type IN ('view','click','error')""",
    "sig": """
  SELECT vid, t, avg(value) / 15 AS motion,
         coalesce(avg(value) FILTER (user_id % 2 = 0), 0.0) AS motion_left,
         coalesce(avg(value) FILTER (user_id % 2 = 1), 0.0) AS motion_right,
         max(value) / 500 AS activity, CASE WHEN count(*) > 2 THEN 1.0::double ELSE 0.0::double END AS celeb,
         CASE WHEN max(event_id) % 2 = 0 THEN 'left' ELSE 'right' END AS celeb_side,
         max(CASE WHEN event_type = 'error' THEN 0.9::double ELSE 0.1::double END) AS faceoff
  FROM ev GROUP BY vid, t""",
    "whistles": """
  SELECT DISTINCT vid, CAST(t + 0.5 AS double) AS t FROM ev WHERE event_type = 'signup' AND value > 20""",
    "det": """
  SELECT l_suppkey % 10 AS vid, CAST(l_orderkey AS int) AS t, l_linenumber::bigint * 10000000 + l_partkey AS box_no,
         CASE l_linenumber % 4 WHEN 0 THEN 'puck' WHEN 1 THEN 'goal' WHEN 2 THEN 'goalie'
           ELSE CASE WHEN l_linenumber = 7 THEN (['centriod', 'faceoff', 'referee', 'player'])[l_partkey % 4 + 1] ELSE 'player' END END AS cls,
         l_discount * 10 AS conf, l_quantity * 10 AS x1, l_tax * 1000 AS y1,
         l_quantity * 10 + 20 + l_linenumber AS x2, l_tax * 1000 + 30 AS y2 FROM lineitem""",
    "calls": """
  SELECT l_orderkey AS seg_id, l_linenumber AS call_no,
         min(CAST(floor(l_quantity) AS int) % 8) AS shots, min(CAST(floor(l_quantity) AS int) % 5) AS sog,
         max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS goals FROM lineitem GROUP BY 1, 2""",
    "games": """
  SELECT c_custkey AS vid,
         CASE c_custkey % 4 WHEN 0 THEN 'Team 0 Club' WHEN 1 THEN 'TEAM 1 club' WHEN 2 THEN 'Team 0 Club. 19U' ELSE 'Club ' || n_name END AS target_team,
         CASE c_custkey % 4 WHEN 0 THEN 'Team 1 Club 19U' WHEN 1 THEN 'Team 0 Club' WHEN 2 THEN 'team 1 club' ELSE c_mktsegment || ' Club' END AS opponent_team,
         CASE WHEN c_custkey % 2 = 0 THEN 'White' ELSE 'Navy Blue' END AS target_color,
         CASE WHEN c_custkey % 7 = 0 THEN (CASE WHEN c_custkey % 2 = 0 THEN 'White' ELSE 'Navy Blue' END)
              WHEN c_custkey % 2 = 0 THEN 'Navy Blue' ELSE 'White' END AS opponent_color,
         CASE WHEN c_custkey % 3 = 0 THEN 'Left' ELSE 'right' END AS target_side,
         CASE WHEN c_custkey % 3 = 0 THEN 'right' ELSE 'left' END AS opponent_side,
         2023 + c_custkey % 3 AS season,
         CASE WHEN c_custkey % 5 = 4 THEN 0 ELSE 3 END AS n_periods
  FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "periods": """
  SELECT vid, CAST(i + 1 AS int) AS num, CAST(i * 240 + 5 AS int) AS p_start, CAST(i * 240 + 230 AS int) AS p_end
  FROM games, LATERAL (SELECT unnest(range(n_periods)) AS i)""",
    "runlog": """
  SELECT vid, ts, event_id, event_type AS field, CAST(floor(value) AS int) % 7 - 3 AS delta FROM ev""",
    "reviews": """
  SELECT event_id % 500 AS clip_id, epoch_us(ts) AS ts, event_id AS pos,
         CASE event_type WHEN 'purchase' THEN 'Accurate' WHEN 'error' THEN 'Correction' ELSE 'Comment' END AS type
  FROM ev WHERE event_type IN ('purchase','error','signup')""",
    "clips": """
  SELECT o_custkey % 50 AS vid, o_orderkey AS clip_no, o_orderdate AS game_ts, CAST(o_orderdate AS date) AS game_date,
         CAST(o_orderkey % 3600 AS int) AS start_s, CAST(o_orderkey % 3600 + 8 + o_orderkey % 23 AS int) AS end_s,
         shots, sog_raw AS sog, sog_raw - goals AS saves, goals,
         CAST(year(o_orderdate) AS int) AS season, CAST(year(o_orderdate) * 1000 + month(o_orderdate) * 10 + CASE WHEN day(o_orderdate) > 15 THEN 1 ELSE 0 END AS int) AS game,
         CAST(year(o_orderdate) * 100 + month(o_orderdate) AS int) AS month, o_orderkey % 3 AS rebounds,
         (['Base (B)','Aggressive (A)','Conservative (C)','Defensive (D)'])[o_orderkey % 4 + 1] AS depth_rank,
         (['Excellent','Good','Average','Poor'])[o_orderkey // 4 % 4 + 1] AS cover_angle_rank,
         (['Poor','Good','Excellent','Average'])[o_orderkey // 3 % 4 + 1] AS squareness_rank,
         (['Killed (Elite)','Goal Allowed','Steered to Low-Danger Zone','Not Applicable','Uncontrolled into High-Danger Zone'])[o_orderkey // 5 % 5 + 1] AS rebound_control_rank,
         CAST(1 + o_orderkey % 5 AS int) AS coaching_confidence,
         CASE WHEN o_orderkey % 6 = 5 THEN NULL ELSE CAST(1 + o_orderkey // 2 % 5 AS int) END AS position_confidence,
         CASE WHEN o_orderkey % 4 = 1 THEN NULL ELSE (o_orderkey % 11) / 10::double END AS beaten_confidence,
         CASE WHEN o_orderkey % 9 = 0 THEN 1 ELSE 0 END AS n_caveats,
         CASE o_orderkey % 5 WHEN 0 THEN 'unknown' WHEN 1 THEN 'left' WHEN 2 THEN 'right' WHEN 3 THEN 'left' ELSE 'right' END AS side,
         (['five_hole','glove_high','blocker_low','unknown','glove_low','blocker_high','body_other'])[o_orderkey % 7 + 1] AS beaten_location,
         (['slot','point','left circle','right circle','crease'])[max_line % 5 + 1] AS shot_location,
         (['wrist','slap','deflection','one-timer'])[o_orderkey % 4 + 1] AS release,
         'Shot from ' || o_orderpriority || CASE WHEN o_orderkey % 8 = 0 THEN ' on a breakaway' ELSE '' END
           || CASE WHEN o_orderkey % 11 = 0 THEN ' with rebound' ELSE '' END AS cue_text
  FROM orders JOIN (
    SELECT l_orderkey, count(*) AS shots, CAST(sum(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) AS bigint) AS sog_raw,
           CAST(sum(CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 1 ELSE 0 END) AS bigint) AS goals,
           max(l_linenumber) AS max_line FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey""",
}
SQL_VIEWS["shots"] = """
  SELECT l_orderkey AS clip_no, l_orderkey % 50 AS vid, l_linenumber * 10000000::bigint + l_partkey AS shot_no,
         (['slot','in close','left circle','point','behind net','right wing','neutral zone'])[l_partkey % 7 + 1] AS location,
         (['wrist','one-timer','slap','redirect-tip','backhand'])[l_suppkey % 5 + 1] AS release,
         CASE l_returnflag WHEN 'R' THEN 'goal' WHEN 'A' THEN 'save' ELSE 'miss' END AS outcome, l_orderkey % 3 AS rebounds,
         CASE WHEN l_orderkey % 8 = 0 THEN 'Odd-man RUSH against' ELSE 'set play' END AS text,
         CASE WHEN l_orderkey % 2 = 0 THEN 'left' ELSE 'right' END AS side, CAST(l_orderkey % 3600 AS int) AS start_s FROM lineitem"""

_NEEDS = {
    "probs": ["ev"], "gt": ["ev"], "win": ["ev"], "sig": ["ev"], "whistles": ["ev"],
    "runlog": ["ev"], "reviews": ["ev"], "periods": ["games"],
}


def sql(views: str, body: str) -> str:
    """Prefix ``body`` (``name AS (...), ... SELECT`` or ``SELECT``) with views."""
    wanted: list[str] = []
    for v in views.split():
        for d in [*_NEEDS.get(v, []), v]:
            if d not in wanted:
                wanted.append(d)
    body = body.strip()
    ctes = [f"{v} AS ({SQL_VIEWS[v]})" for v in wanted]
    if body.upper().startswith("SELECT"):
        return ("WITH RECURSIVE " + ",\n".join(ctes) + "\n" if ctes else "") + body
    return "WITH RECURSIVE " + "".join(c + ",\n" for c in ctes) + body
