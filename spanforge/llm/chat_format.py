"""Chat formatting: tool calls linked to their results, ordered, validated and written as canonical JSON.

In DataFrame functions only.  Calls and results meet in a hash join on
(conversation, call id).  A call may name one earlier call it builds on; these
links form forests, whose depth is found by pointer doubling (log2 of the deepest
chain rounds), so a message sorts by (depth of its call, turn, call before result):
a topological order without ever gathering a conversation, which may hold a large
part of all rows.  Arguments are parsed as VARIANT, their members are joined to the
schema of the tool, and errors are listed in sorted order.

Canonical JSON: members in code point order, no blanks, null members left out.

Defined results: a call without result, a result without call, a call whose parent is
unknown, and calls in a cycle are kept and marked in ``status``; of several results
of one call the earliest is linked and the others are marked; repeated calls of one id
share it: each is linked; arguments that are no JSON object are one error; calls of a
tool without schema are one error; null call ids link with nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from .common import bounded, read, saved, written

#: tool, argument, type, required
SCHEMAS = [
    ("search", "limit", "BIGINT", False), ("search", "query", "STRING", True), ("translate", "strict", "BOOLEAN", False), ("translate", "target", "STRING", True), ("translate", "text", "STRING", True),
    ("measure", "scale", "DECIMAL", False), ("measure", "words", "BIGINT", True),
]


def depths(calls: DataFrame, limit: int = 64) -> DataFrame:
    """``conv, call, depth, cyclic`` of each (conv, call) with its ``parent``: steps to the first call of its chain."""
    node = written(calls.where("call is not null").groupBy("conv", "call").agg(F.min("parent").alias("up")))
    known = node.select(F.col("conv").alias("k_conv"), F.col("call").alias("k_call"))
    at = node.join(known, (F.col("conv").eqNullSafe(F.col("k_conv"))) & (F.col("up") == F.col("k_call")), "left")
    at = written(at.select("conv", "call", F.col("k_call").alias("up"), F.when(F.col("k_call").isNotNull(), 1).otherwise(0).cast("long").alias("depth")))
    for _ in range(limit):  # a chain without a cycle ends after log2 of its length rounds
        if at.where("up is not null").isEmpty():
            break
        far = at.select(F.col("conv").alias("k_conv"), F.col("call").alias("k_call"), F.col("up").alias("k_up"), F.col("depth").alias("k_depth"))
        new = at.join(far, F.col("conv").eqNullSafe(F.col("k_conv")) & (F.col("up") == F.col("k_call")), "left")
        new = written(new.select("conv", "call", F.col("k_up").alias("up"), (F.col("depth") + F.coalesce("k_depth", F.lit(0))).alias("depth")))
        if new.where("up is not null").count() == at.where("up is not null").count():  # only cycles are left
            at = new
            break
        at = new
    return at.select("conv", "call", F.when(F.col("up").isNull(), F.col("depth")).otherwise(0).alias("depth"), F.col("up").isNotNull().alias("cyclic"))


def argument_errors(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """``row_id`` and the sorted ``errors`` of calls with any; ``schemas`` is a small table of tool, argument, type, required."""
    s = saved(schemas)
    c = calls.select("row_id", "tool", F.try_parse_json("arguments").alias("v"))
    c = c.withColumn("object", F.coalesce(F.schema_of_variant("v").startswith("OBJECT<"), F.lit(False)))
    wrong = c.where("not object").select("row_id", F.lit("arguments: no object").alias("error"))
    good = c.where("object")
    tools = s.select("tool").distinct()
    unknown = good.join(bounded(saved(tools)), "tool", "left_anti").select("row_id", F.lit("tool: unknown").alias("error"))
    members = good.join(F.broadcast(s.select("tool").distinct()) if s.count() <= 10_000 else tools, "tool").select("row_id", "tool", F.explode(F.map_entries(F.expr("cast(v as map<string, variant>)"))).alias("m"))
    members = members.select("row_id", "tool", F.col("m.key").alias("argument"), F.regexp_extract(F.schema_of_variant("m.value"), r"^\w+", 0).alias("is"))
    typed = members.join(bounded(s), ["tool", "argument"], "left")
    fits = (F.col("is") == F.col("type")) | ((F.col("type") == "DECIMAL") & F.col("is").isin("BIGINT", "DOUBLE"))
    odd = typed.where(F.col("type").isNull() | ~fits).select("row_id", F.concat(F.col("argument"), F.when(F.col("type").isNull(), F.lit(": unexpected")).otherwise(F.lit(": wrong type"))).alias("error"))
    due = good.select("row_id", "tool").join(bounded(s).where("required"), "tool").select("row_id", "argument")
    lacking = due.join(members.select("row_id", "argument"), ["row_id", "argument"], "left_anti").select("row_id", F.concat("argument", F.lit(": missing")).alias("error"))
    return wrong.union(unknown).union(odd).union(lacking).groupBy("row_id").agg(F.array_sort(F.collect_set("error")).alias("errors"))


def canonical(**members: Column) -> Column:
    return F.to_json(F.struct(*[members[k].alias(k) for k in sorted(members)]))


def link_tool_calls(messages: DataFrame, calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row per message, call and result: conv, depth, turn, kind, call, status, errors, json.

    ``messages``: conv, turn, role, text; ``calls``: conv, turn, call, parent, tool,
    arguments (JSON text); ``results``: conv, turn, call, content.  (depth, turn, kind)
    orders a conversation: a call follows the call it builds on, a result its call.
    """
    calls = saved(calls.withColumn("row_id", F.monotonically_increasing_id()))
    deep = depths(calls)
    c = calls.join(deep.select(F.col("conv").alias("d_conv"), F.col("call").alias("d_call"), "depth", "cyclic"), F.col("conv").eqNullSafe(F.col("d_conv")) & (F.col("call") == F.col("d_call")), "left")
    c = c.join(argument_errors(calls, schemas), "row_id", "left").withColumn("errors", F.coalesce("errors", F.array().cast("array<string>"))).withColumn("depth", F.coalesce("depth", F.lit(0)))
    heads = c.where("call is not null").groupBy("conv", "call").agg(F.min("depth").alias("depth"), F.min("tool").alias("tool"))
    first = W.partitionBy("conv", "call").orderBy(F.col("turn").asc_nulls_last(), "content")
    r = results.withColumn("nth", F.row_number().over(first))
    r = r.join(heads.select(F.col("conv").alias("h_conv"), F.col("call").alias("h_call"), "depth", "tool"), F.col("conv").eqNullSafe(F.col("h_conv")) & (F.col("call") == F.col("h_call")), "left")
    answered = results.where("call is not null").select(F.col("conv").alias("a_conv"), F.col("call").alias("a_call")).distinct()
    c = c.join(answered, F.col("conv").eqNullSafe(F.col("a_conv")) & (F.col("call") == F.col("a_call")), "left")
    c_status = F.when(F.col("cyclic"), "cycle").when(F.col("call").isNull(), "no id").when(F.col("parent").isNotNull() & (F.col("depth") == 0), "unknown parent").when(F.col("a_call").isNull(), "no result").otherwise("linked")
    r_status = F.when(F.col("call").isNull(), "no id").when(F.col("h_call").isNull(), "no call").when(F.col("nth") > 1, "extra").otherwise("linked")
    none = F.array().cast("array<string>")
    arguments = F.coalesce(F.to_json(F.try_parse_json("arguments")), F.col("arguments"))
    columns = ["conv", "depth", "turn", "kind", "call", "status", "errors", "json"]
    said = messages.select("conv", F.lit(0).cast("long").alias("depth"), "turn", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("call"), F.lit("message").alias("status"), none.alias("errors"), canonical(content=F.col("text"), role=F.col("role")).alias("json"))
    asked = c.select("conv", "depth", "turn", F.lit(1).alias("kind"), "call", c_status.alias("status"), "errors", canonical(arguments=arguments, id=F.col("call"), parent=F.col("parent"), role=F.lit("assistant"), tool=F.col("tool"), type=F.lit("call")).alias("json"))
    told = r.select("conv", F.coalesce("depth", F.lit(0)).cast("long").alias("depth"), "turn", F.lit(2).alias("kind"), "call", r_status.alias("status"), none.alias("errors"), canonical(content=F.col("content"), id=F.col("call"), role=F.lit("tool"), tool=F.col("tool"), type=F.lit("result")).alias("json"))
    return said.select(columns).unionByName(asked.select(columns)).unionByName(told.select(columns))


def derived_calls(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results read out of plain conversations, which have none.

    Every assistant turn is taken as a call prompted by the text of its own turn and
    every user turn as the result of the call of the turn before it.  A call builds on
    that of two turns earlier.  Tool and arguments follow from the whole text, so that some
    calls lack an argument, have one of a wrong type or one too many.
    """
    name = lambda turn: F.concat_ws("-", F.lit("call"), F.col("conv_id").cast("string"), turn.cast("string"))
    n, k = F.coalesce(F.length("text"), F.lit(0)), F.pmod(F.coalesce(F.length("text"), F.lit(0)), F.lit(3))
    whole = F.coalesce("text", F.lit(""))
    search = F.when(n % 5 == 0, F.to_json(F.struct(n.alias("limit")))).otherwise(F.to_json(F.struct(n.alias("limit"), whole.alias("query"))))
    translate = F.when(n % 7 == 0, F.to_json(F.struct(F.lit("yes").alias("strict"), F.lit("en").alias("target"), whole.alias("text")))).otherwise(F.to_json(F.struct((n % 2 == 0).alias("strict"), F.lit("en").alias("target"), whole.alias("text"))))
    measure = F.when(n % 11 == 0, F.to_json(F.struct(n.alias("depth"), (n / F.lit(2.0)).alias("scale"), n.alias("words")))).when(n % 13 == 0, F.lit("[]")).otherwise(F.to_json(F.struct(n.alias("words"))))
    a = turns.where("role = 'assistant'")
    calls = a.select(F.col("conv_id").alias("conv"), "turn", name(F.col("turn")).alias("call"), F.when(F.col("turn") >= 3, name(F.col("turn") - 2)).alias("parent"),
        F.when(k == 0, "search").when(k == 1, "translate").otherwise("measure").alias("tool"), F.when(k == 0, search).when(k == 1, translate).otherwise(measure).alias("arguments"))
    results = turns.where("role = 'user'").select(F.col("conv_id").alias("conv"), "turn", name(F.col("turn") - 1).alias("call"), F.col("text").alias("content"))
    return calls, results


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    calls, results = derived_calls(turns)
    names = ("tool", "argument", "type", "required")
    schemas = spark.range(1).select(F.inline(F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip(names, row)]) for row in SCHEMAS])))
    out = link_tool_calls(turns.select(F.col("conv_id").alias("conv"), "turn", "role", "text"), calls, results, schemas)
    return out.select(F.col("conv").alias("conv_id"), "depth", "turn", "kind", F.col("call").alias("call_id"), "status", F.concat_ws(";", "errors").alias("errors"), "json")


SQL = f"""
with recursive t as (select *, coalesce(length(text), 0) as n, to_json(coalesce(text, ''))::varchar as s from conversations),
c as (select conv_id, turn, 'call-' || conv_id || '-' || turn as call, case when turn >= 3 then 'call-' || conv_id || '-' || (turn - 2) end as parent, n, s, n % 3 as k from t where role = 'assistant'),
a as (select *, case k when 0 then 'search' when 1 then 'translate' else 'measure' end as tool,
  case when k = 0 then '{{"limit":' || n || case when n % 5 = 0 then '' else ',"query":' || s end || '}}'
    when k = 1 then '{{"strict":' || case when n % 7 = 0 then '"yes"' when n % 2 = 0 then 'true' else 'false' end || ',"target":"en","text":' || s || '}}'
    when n % 11 = 0 then '{{"depth":' || n || ',"scale":' || (n // 2) || case when n % 2 = 0 then '' else '.5' end || ',"words":' || n || '}}'
    when n % 13 = 0 then '[]' else '{{"words":' || n || '}}' end as arguments,
  case when k = 0 and n % 5 = 0 then 'query: missing' when k = 1 and n % 7 = 0 then 'strict: wrong type' when k = 2 and n % 11 = 0 then 'depth: unexpected' when k = 2 and n % 13 = 0 then 'arguments: no object' else '' end as errors from c),
u as (select distinct call, parent from c),
d as (select call, 0::bigint as depth from u where parent is null or parent not in (select call from u) union all select u.call, d.depth + 1 from u join d on u.parent = d.call),
r as (select conv_id, turn, text, 'call-' || conv_id || '-' || (turn - 1) as call, row_number() over (partition by conv_id, turn order by text) as nth from t where role = 'user'),
h as (select call, min(tool) as tool from a group by call)
select conv_id, 0::bigint as depth, turn, 0 as kind, null::varchar as call_id, 'message' as status, '' as errors,
  '{{' || case when text is null then '' else '"content":' || to_json(text)::varchar || case when role is null then '' else ',' end end || case when role is null then '' else '"role":' || to_json(role)::varchar end || '}}' as json from t
union all
select conv_id, depth, turn, 1, call, case when parent is not null and depth = 0 then 'unknown parent' when call not in (select call from r) then 'no result' else 'linked' end, errors,
  '{{"arguments":' || to_json(arguments)::varchar || ',"id":"' || call || '"' || case when parent is null then '' else ',"parent":"' || parent || '"' end || ',"role":"assistant","tool":"' || tool || '","type":"call"}}' from a join d using (call)
union all
select conv_id, coalesce(depth, 0), turn, 2, call, case when h.call is null then 'no call' when nth > 1 then 'extra' else 'linked' end, '',
  '{{' || case when text is null then '' else '"content":' || to_json(text)::varchar || ',' end || '"id":"' || call || '","role":"tool"' || case when tool is null then '' else ',"tool":"' || tool || '"' end || ',"type":"result"}}'
from r left join h using (call) left join d using (call)"""
