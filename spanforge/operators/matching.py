"""Joins and one-to-one matching between predictions and ground truth."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..blocks import BLOCK, carry, cut, point_join, span_join
from ..functions.spans import iou, midpoint
from ..functions.text import teams_match
from ..functions.timefmt import fmt_mmss, parse_mmss
from .intervals import as_of

KEYS = ["vid"]
#: rounds of parallel choices before an ordered scan takes over
ROUNDS = 12


# -- nearest and covering ---------------------------------------------------


def annotate(cand: DataFrame, gt: DataFrame, tol: float = 5.0, block: int = BLOCK) -> DataFrame:
    """Nearest ground-truth midpoint within ``tol`` of each candidate.

    ``cand`` has ``(vid, t_seconds)`` plus other columns, ``gt`` has ``gt_id``
    in list order; the first of equally near windows wins.
    """
    times = cand.select("vid", F.col("t_seconds").alias("__t")).distinct()
    mids = gt.select("vid", midpoint(F.col("start_s"), F.col("end_s")).alias("__mid"), "gt_id", "team")
    near = (
        point_join(
            times.withColumn("__lo", F.col("__t") - tol).withColumn("__hi", F.col("__t") + tol),
            mids, KEYS, ("__lo", "__hi"), "__mid", block,
        )
        .withColumn("__d", F.abs(F.col("__t") - F.col("__mid")))
        .groupBy("vid", "__t")
        .agg(F.min_by(F.struct("__mid", "__d", "team"), F.struct("__d", "gt_id")).alias("__g"))
        .withColumnRenamed("__t", "t_seconds")
    )
    out = cand.join(near, ["vid", "t_seconds"], "left")
    dash = F.lit("—")
    return out.select(
        *cand.columns,
        F.col("__g.__mid").cast("int").alias("gt_match_t_seconds"),
        F.coalesce(fmt_mmss(F.col("__g.__mid")), dash).alias("gt_match_t_mmss"),
        F.bround("__g.__d", 1).alias("gt_match_delta_s"),
        F.coalesce("__g.team", dash).alias("gt_team"),
    )


def covered(points: DataFrame, spans: DataFrame, t: str, out: str = "covered") -> DataFrame:
    """Flag points lying inside some span (closed ends).

    A point is covered iff the furthest end among spans starting at or before
    it reaches it, so one ordered pass is enough and no pairs are formed.
    """
    ends = spans.groupBy("vid", F.col("start_s").cast("double").alias("__t")).agg(F.max("end_s").cast("double").alias("__e"))
    times = points.select("vid", F.col(t).cast("double").alias("__t")).distinct()
    both = ends.withColumn("__side", F.lit(0)).unionByName(times.withColumn("__side", F.lit(1)), allowMissingColumns=True)
    both = carry(both, KEYS, "__t", {"__reach": ("max", F.col("__e"))}, ["__t", "__side"]).filter("__side = 1")
    flags = both.select("vid", "__t", F.coalesce(F.col("__reach") >= F.col("__t"), F.lit(False)).alias(out))
    return points.withColumn("__t", F.col(t).cast("double")).join(flags, ["vid", "__t"]).drop("__t")


def coverage(gt: DataFrame, seg: DataFrame) -> DataFrame:
    """Ground truth whose midpoint falls inside a threat segment."""
    mids = gt.withColumn("__mid", midpoint(F.col("start_s"), F.col("end_s")))
    return covered(mids, seg, "__mid").drop("__mid")


def midpoint_hits(gt: DataFrame, pred: DataFrame) -> DataFrame:
    """Many-to-many midpoint hits of both sides, per recording."""
    mid = midpoint(F.col("start_s"), F.col("end_s"))
    g = covered(gt.withColumn("__mid", mid), pred, "__mid", "hit").groupBy("vid").agg(
        F.count_if("hit").alias("gt_hits"), F.count("*").alias("gt_total")
    )
    p = covered(pred.withColumn("__mid", mid), gt, "__mid", "hit").groupBy("vid").agg(
        F.count_if("hit").alias("pred_hits"), F.count("*").alias("pred_total")
    )
    zero = F.lit(0).cast("long")
    # a full outer join: a recording may lack either side
    return g.join(p, "vid", "full_outer").select(
        "vid", *[F.coalesce(c, zero).alias(c) for c in ("gt_hits", "gt_total", "pred_hits", "pred_total")]
    )


def nearest(df: DataFrame, pool: DataFrame, idx: str, out: str = "near") -> DataFrame:
    """Nearest pool span by midpoint distance with its IoU, at any distance.

    Looks up the neighbours before and after; equal distances go to the lower
    pool index.  Adds ``out`` = struct(idx, start_s, end_s, dist, iou).
    """
    mid = midpoint(F.col("start_s"), F.col("end_s"))
    targets = df.withColumn("__mid", mid)
    p = pool.select("vid", mid.alias("__pm"), F.col(idx).alias("idx"), "start_s", "end_s")
    back = as_of(targets, p, "__mid", "__pm", "__b", rank=[-F.col("idx")])
    both = as_of(back, p, "__mid", "__pm", "__f", forward=True, rank=[F.col("idx")])
    db, df_ = F.col("__mid") - F.col("__b.__pm"), F.col("__f.__pm") - F.col("__mid")
    take_b = F.col("__f").isNull() | (db < df_) | ((db == df_) & (F.col("__b.idx") < F.col("__f.idx")))
    hit = F.when(F.col("__b").isNotNull() & take_b, F.col("__b")).otherwise(F.col("__f"))
    dist = F.abs(hit["__pm"] - F.col("__mid"))
    score = iou(F.col("start_s"), F.col("end_s"), hit["start_s"], hit["end_s"])
    near = F.when(
        hit.isNotNull(),
        F.struct(hit["idx"].alias("idx"), hit["start_s"].alias("start_s"), hit["end_s"].alias("end_s"), dist.alias("dist"), score.alias("iou")),
    )
    return both.withColumn(out, near).drop("__mid", "__b", "__f")


def trace_lookup(pred: DataFrame, trace: DataFrame, tol: float = 0.5, block: int = BLOCK) -> DataFrame:
    """First trace entry whose bounds are both within ``tol`` of a prediction.

    ``trace`` has ``(vid, ord, start_s, end_s, source_signals, n_raw)``.
    """
    spans = pred.select("vid", "start_s", "end_s").distinct().selectExpr(
        "vid", "start_s as __s", "end_s as __e", f"start_s - {tol}D as __lo", f"start_s + {tol}D as __hi"
    )
    t = trace.select("vid", F.col("start_s").alias("__ts"), F.col("end_s").alias("__te"), "ord", "source_signals", "n_raw")
    hit = (
        point_join(spans, t, KEYS, ("__lo", "__hi"), "__ts", block)
        .filter((F.abs(F.col("__ts") - F.col("__s")) < tol) & (F.abs(F.col("__te") - F.col("__e")) < tol))
        .groupBy("vid", F.col("__s").alias("start_s"), F.col("__e").alias("end_s"))
        .agg(F.min_by(F.struct("source_signals", "n_raw"), "ord").alias("__hit"))
    )
    out = pred.join(hit, ["vid", "start_s", "end_s"], "left")
    return out.select(
        *pred.columns,
        F.coalesce("__hit.source_signals", F.expr("cast(array() as array<string>)")).alias("source_signals"),
        F.coalesce("__hit.n_raw", F.lit(0)).alias("n_raw"),
    )


# -- greedy one-to-one matching ----------------------------------------------


def _settle(pairs: DataFrame) -> DataFrame:
    """Mark pairs that are the best of both their members (``__top``), and drop the others that share a member with one.

    Windows run over the pairs of one member, whatever the recording's size.
    """
    by_g, by_p = W.partitionBy("vid", "gt_id"), W.partitionBy("vid", "pred_id")
    x = pairs.withColumn("__bg", F.min("__o").over(by_g) == F.col("__o"))
    x = x.withColumn("__top", F.col("__bg") & (F.min("__o").over(by_p) == F.col("__o")))
    x = x.withColumn("__tp", F.max("__top").over(by_p))
    x = x.withColumn("__tg", F.max("__top").over(by_g))
    return x.filter(F.col("__top") | ~(F.col("__tp") | F.col("__tg"))).drop("__bg", "__tp", "__tg")


def ordered_scan(pairs: DataFrame, a: str, b: str, order: str = "__o") -> DataFrame:
    """Take the pairs of each recording in order, each side at most once, in one pass.

    Rows are dealt by recording, sorted and streamed; what is held are the ids taken so
    far.  For what rounds leave over: chains in which each choice waits for the one before.
    """
    rows = pairs.repartition("vid").sortWithinPartitions("vid", order).select(*[c for c in pairs.columns if c != order])
    at_v, at_a, at_b = (rows.columns.index(c) for c in ("vid", a, b))

    def run(batches):
        vid, used_a, used_b = None, set(), set()
        for batch in batches:
            keep = []
            for k, (v, x, y) in enumerate(zip(*(batch.column(c).to_pylist() for c in (at_v, at_a, at_b)), strict=True)):
                if v != vid:
                    vid, used_a, used_b = v, set(), set()
                if x not in used_a and y not in used_b:
                    used_a.add(x), used_b.add(y), keep.append(k)
            yield batch.take(pa.array(keep, pa.int64()))

    return rows.mapInArrow(run, rows.schema)


def _dominant(pairs: DataFrame, order: Sequence[Column], rounds: int = ROUNDS) -> DataFrame:
    """Take pairs in ``order``, each side at most once: ``(vid, gt_id, pred_id, score)``.

    A pair that is the best of both its members is taken by any greedy run, and what
    shares a member with it is not.  Each round of that rule is written once.  A round
    settles a fixed share of the open pairs on average; scores that improve steadily
    along a chain settle one by one, so after ``rounds`` what is left is scanned in order.
    """
    rest, taken = pairs.select("vid", "gt_id", "pred_id", "score", F.struct(*order).alias("__o")), None
    for _ in range(rounds):
        x = cut(_settle(rest))
        top = x.filter("__top").drop("__top", "__o")
        taken = top if taken is None else taken.unionByName(top)
        rest = x.filter("not __top").drop("__top")
        if rest.isEmpty():
            return taken
    left = ordered_scan(rest, "gt_id", "pred_id")
    return left if taken is None else taken.unionByName(left)


def match_iou(gt: DataFrame, pred: DataFrame, thr: float = 0.30, block: int = BLOCK) -> DataFrame:
    """Greedy one-to-one match by IoU: ``(vid, gt_id, pred_id, score)``.

    Best IoU first; ties go to the larger ground-truth, then prediction index.
    """
    if thr <= 0:
        raise ValueError("thr must be positive: pairs that do not overlap never meet")
    g = gt.select("vid", "gt_id", F.col("start_s").alias("g_s"), F.col("end_s").alias("g_e"))
    p = pred.select("vid", "pred_id", F.col("start_s").alias("p_s"), F.col("end_s").alias("p_e"))
    score = iou(F.col("g_s"), F.col("g_e"), F.col("p_s"), F.col("p_e"))
    pairs = span_join(g, p, KEYS, ("g_s", "g_e"), ("p_s", "p_e"), block).withColumn("score", score).filter(F.col("score") >= thr)
    order = [-F.col("score"), -F.col("gt_id"), -F.col("pred_id")]
    return _dominant(pairs, order)


def match_tolerance(gt: DataFrame, pred: DataFrame, tol: float = 5.0, block: int = BLOCK) -> DataFrame:
    """Greedy one-to-one match of points ``t`` by distance, at most ``tol``."""
    g = gt.select("vid", "gt_id", F.col("t").alias("g_t")).withColumn("__lo", F.col("g_t") - tol).withColumn("__hi", F.col("g_t") + tol)
    p = pred.select("vid", "pred_id", F.col("t").alias("p_t"))
    pairs = point_join(g, p, KEYS, ("__lo", "__hi"), "p_t", block).withColumn("score", F.abs(F.col("g_t") - F.col("p_t")))
    order = [F.col("score"), F.col("gt_id"), F.col("pred_id")]
    return _dominant(pairs, order)


def unmatched(side: DataFrame, matches: DataFrame, id_col: str) -> DataFrame:
    return side.join(matches.select("vid", id_col), ["vid", id_col], "left_anti")


def shot_list(seg: DataFrame) -> DataFrame:
    """Shot predictions ``(vid, pred_id, t, timestamp, location, release, outcome)`` of threat segments.

    ``seg``: ``vid, ord`` (place in the list), ``start_s, end_s, threat, shot_timestamps``
    (clip-relative ``MM:SS``).  Malformed times are left out, times beyond the segment
    count as its end.  ``pred_id`` is (place of the segment, place in its list).
    """
    shots = seg.filter("threat").select("vid", "ord", "start_s", "end_s", F.posexplode("shot_timestamps").alias("pos", "x"))
    start, end = (F.coalesce(F.col(c), F.lit(0)).cast("double") for c in ("start_s", "end_s"))
    text = F.coalesce("x.timestamp", F.lit(""))
    x = shots.withColumn("__at", parse_mmss(text)).filter("__at is not null")
    words = [F.coalesce(f"x.{c}", F.lit("")).alias(c) for c in ("location", "release", "outcome")]
    return x.select("vid", F.struct("ord", "pos").alias("pred_id"), F.least(start + F.col("__at"), end).alias("t"), text.alias("timestamp"), *words)


def shots_against(gt: DataFrame, seg: DataFrame, tmap: DataFrame, color: str = "color") -> DataFrame:
    """Ground-truth shots of the team that threatens a recording's goalie.

    The goalie's colour is that of the first threat segment that names one (by ``ord``);
    where it points to no single team, or the two teams share a colour, all shots count.
    """
    from .identity import target_team

    named = seg.filter(F.col("threat") & (F.coalesce(F.col(color), F.lit("")) != ""))
    first = named.groupBy("vid").agg(F.min_by(color, "ord").alias(color))
    team = target_team(first, tmap.filter("not collision"), color).select("vid", F.col("target_team").alias("__team"))
    x = gt.filter("action = 'Shots'").join(team, "vid", "left")
    return x.filter(F.col("__team").isNull() | teams_match(F.col("team"), F.col("__team"))).drop("__team")


def _zones(pred: DataFrame, shots: DataFrame) -> DataFrame:
    """``(vid, __t, __side, zone)`` of each time of a prediction (1) and each opening of a shot (0).

    Predictions next to each other share a zone if some shot is open at both; a shot
    belongs to the zone of the first prediction in its reach, if there is one.
    """
    opened = shots.groupBy("vid", F.col("lo").alias("__t")).agg(F.max("hi").alias("__hi")).withColumn("__side", F.lit(0))
    times = pred.select("vid", F.col("t").alias("__t")).distinct().withColumn("__side", F.lit(1))
    x = opened.unionByName(times, allowMissingColumns=True)
    order, is_pred = ["__t", "__side"], F.col("__side") == 1
    x = carry(x, KEYS, "__t", {"__reach": ("max", F.col("__hi"))}, order)
    x = carry(x, KEYS, "__t", {"__before": ("max", F.when(is_pred, F.col("__reach")))}, order)
    x = x.withColumn("__head", F.when(is_pred & (F.col("__before").isNull() | (F.col("__before") < F.col("__t"))), F.col("__t")))
    x = carry(x, KEYS, "__t", {"__zone": ("max", F.col("__head"))}, order)
    x = x.withColumn("__zone", F.when(is_pred, F.coalesce("__head", "__zone")))
    x = carry(x, KEYS, "__t", {"__next": ("last", F.when(is_pred, F.struct("__zone", "__t")))}, order, reverse=True)
    zone = F.when(is_pred, F.col("__zone")).when(F.col("__next.__t") <= F.col("__hi"), F.col("__next.__zone"))
    return x.select("vid", "__t", "__side", zone.alias("zone")).filter("zone is not null")


def match_shots(pred: DataFrame, gt: DataFrame, tol: float = 3.0) -> DataFrame:
    """Sequential match of shot predictions to covered ground-truth shots.

    Predictions go in time order.  Each scans the free shots by start: a shot
    containing it replaces the current choice when its midpoint is nearer; one
    within ``tol`` only while no containing shot has been chosen.

    A zone (predictions bridged by open shots) is streamed in time order.  A shot is
    held from ``tol`` before its start until it is taken or ``tol`` past its end, so the
    state is what is open at one moment, whatever the length of the zone.

    ``pred``: ``(vid, pred_id, t)``; ``gt``: ``(vid, gt_id, start_s, end_s)``
    with ids in list order.  Returns every prediction with ``gt_id`` and
    ``match_class`` (``inside``, ``tolerance`` or null).
    """
    p = pred.select("vid", "pred_id", F.col("t").cast("double").alias("t"))
    start, end = F.col("start_s").cast("double"), F.col("end_s").cast("double")
    g = gt.select("vid", "gt_id", start.alias("s"), end.alias("e"), (start - tol).alias("lo"), (end + tol).alias("hi")).filter("lo <= hi")
    zones = _zones(p, g)
    preds = p.withColumnRenamed("t", "__t").withColumn("__side", F.lit(1))
    shots = g.select("vid", F.col("lo").alias("__t"), F.lit(0).alias("__side"), "gt_id", "s", "e", "hi")
    rows = shots.unionByName(preds, allowMissingColumns=True).join(zones, ["vid", "__t", "__side"])
    rows = rows.repartition("vid", "zone").sortWithinPartitions("vid", "zone", "__t", "__side", "gt_id", "pred_id").select("vid", "zone", "__t", "__side", "gt_id", "s", "e", "hi", "pred_id")
    out = T.StructType([rows.schema["vid"], rows.schema["pred_id"], rows.schema["gt_id"], T.StructField("match_class", T.StringType())])
    kinds = to_arrow_schema(out)

    def choose(live, t):
        best, cls, near = None, None, float("inf")
        for shot in live:
            d = abs(t - 0.5 * (shot[1] + shot[2]))
            inside = shot[1] <= t <= shot[2]
            if d < near and (inside or cls != "inside"):
                best, cls, near = shot, "inside" if inside else "tolerance", d
        return best, cls

    def run(batches):
        key, live = None, []
        for batch in batches:
            made = []
            for vid, zone, t, side, gt_id, s, e, hi, pred_id in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (vid, zone) != key:
                    key, live = (vid, zone), []
                if side == 0:
                    live.append((gt_id, s, e, hi))
                    continue
                live = [shot for shot in live if shot[3] >= t]
                best, cls = choose(live, t)
                if best:
                    live.remove(best)
                    made.append((vid, pred_id, best[0], cls))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*made, strict=True)) or [[]] * 4, kinds, strict=True)], schema=kinds)

    return pred.join(rows.mapInArrow(run, out), ["vid", "pred_id"], "left")


def shot_counts(matched: DataFrame, gt: DataFrame) -> DataFrame:
    """Per-recording shot-level counts after matching.

    A tolerance match counts as lenient hit and as false positive and uses up
    its shot.  ``gt`` carries ``covered``.
    """
    m = matched.groupBy("vid").agg(
        F.count("*").alias("n_pred"),
        F.count_if(F.col("match_class") == "inside").alias("tp_strict"),
        F.count_if(F.col("match_class").isNotNull()).alias("tp_lenient"),
    )
    g = gt.groupBy("vid").agg(F.count("*").alias("n_gt"), F.count_if("covered").alias("n_covered"))
    x = g.join(m, "vid", "full_outer").na.fill(0)
    return x.select(
        "vid", "n_pred", "n_gt", "n_covered", "tp_strict", "tp_lenient",
        (F.col("n_pred") - F.col("tp_strict")).alias("fp"),
        (F.col("n_covered") - F.col("tp_lenient")).alias("fn"),
        (F.col("n_gt") - F.col("n_covered")).alias("fn_uncovered"),
    )


# -- counts per window -------------------------------------------------------


def window_counts(seg: DataFrame, ev: DataFrame, actions: Sequence[str] = ("Shots", "Goals"), block: int = BLOCK) -> DataFrame:
    """Events overlapping each segment (half-open) by action.

    With a ``target_team`` column in ``seg`` the ``gt_*`` counts keep only that
    team's events; ``*_unfiltered`` counts keep all.  Events are reduced to
    distinct spans with a multiplicity before the range join.
    """
    spans = ev.groupBy("vid", F.col("start_s").alias("e_s"), F.col("end_s").alias("e_e"), "team", "action").agg(F.count("*").alias("__n"))
    has_team = "target_team" in seg.columns
    keys = ["vid", "start_s", "end_s"] + (["target_team"] if has_team else [])
    wins = seg.select(*keys).distinct()
    hits = span_join(wins, spans, KEYS, ("start_s", "end_s"), ("e_s", "e_e"), block).filter("e_e > start_s and e_s < end_s")
    mine = F.lit(True)
    if has_team:
        # names are compared once per game: a few teams against a few targets
        teams, targets = ev.select("vid", "team").distinct(), seg.filter("target_team is not null").select("vid", "target_team").distinct()
        same = teams.join(targets, "vid").filter(teams_match(F.col("team"), F.col("target_team"))).withColumn("__same", F.lit(True))
        hits = hits.join(same, ["vid", "team", "target_team"], "left")
        mine = F.col("target_team").isNull() | F.coalesce("__same", F.lit(False))
    aggs = [F.sum("__n").alias("n_overlapping")]
    for a in actions:
        name = a.lower().replace(" ", "_")
        aggs.append(F.sum(F.when((F.col("action") == a) & mine, F.col("__n"))).alias(f"gt_{name}"))
        aggs.append(F.sum(F.when(F.col("action") == a, F.col("__n"))).alias(f"gt_{name}_unfiltered"))
    made = hits.groupBy(*keys).agg(*aggs)
    counts = [c for c in made.columns if c not in keys]
    made = made.select(*[F.col(c).alias(f"__{c}") for c in keys], *counts)
    cond = [F.col(c).eqNullSafe(F.col(f"__{c}")) if c == "target_team" else F.col(c) == F.col(f"__{c}") for c in keys]
    return seg.join(made, cond, "left").select(*seg.columns, *counts).na.fill(0, counts)
