"""Clip records: cleaning model replies, voting, refinement, reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..blocks import BLOCK, cut, once, span_join
from ..functions.labels import clean_enum, is_generic, normalize_conf, recover_json
from ..functions.selection import medians
from ..functions.text import clip_id
from ..functions.timefmt import parse_mmss
from .matching import ROUNDS, ordered_scan


# Fixed schema of a metrics reply.
SHOT = (
    "struct<timestamp:string,location:string,release:string,outcome:string,"
    "feature_puck_traveling_toward_net:boolean,feature_puck_release_frame_visible:boolean,"
    "feature_puck_impact_sound_audible:boolean,feature_puck_carrier_holds_or_passes:boolean>"
)
ANCHORS = ("anchor_puck_crosses_line", "anchor_ref_points_at_net", "anchor_puck_retrieved_from_net")
SUPPORTS = ("support_whistle", "support_crowd_spike", "support_celebration", "support_centre_ice_faceoff")
CRITERIA = (
    "struct<" + ",".join(f"{k}:boolean" for k in ANCHORS + SUPPORTS + ("disqualifier_active",))
    + ",confirming_detail:string,decision_notes:string>"
)
METRICS = f"shots int, shotsOnNet int, saves int, goals int, rebounds int, observed_goalie_side string, shot_timestamps array<{SHOT}>, goal_criteria {CRITERIA}"


# -- metrics replies ----------------------------------------------------------


def parse_metrics(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Decode replies into columns, recovering truncated texts."""
    x = once(df, "__t", recover_json(F.col(raw)))
    state = F.when(F.col("__t").isNull(), "failed").when(F.col("__t") == F.col(raw), "ok").otherwise("recovered")
    x = once(x.withColumn("parse_state", state), "__m", F.from_json(F.col("__t"), METRICS))
    m = F.col("__m")
    zero = lambda k: F.coalesce(m[k], F.lit(0))
    return x.select(
        *[c for c in df.columns if c != raw], "parse_state",
        zero("shots").alias("shots"), zero("shotsOnNet").alias("sog"), zero("saves").alias("saves"), zero("goals").alias("goals"),
        m["shot_timestamps"].alias("shot_timestamps"), m["goal_criteria"].alias("goal_criteria"),
    )


def fix_identity(df: DataFrame) -> DataFrame:
    """Shots on goal must equal saves plus goals."""
    total = F.col("saves") + F.col("goals")
    return df.withColumn("fixed_identity", F.col("sog") != total).withColumn("sog", total)


def _demote(shots: Column, when: Column) -> Column:
    return F.when(
        when, F.transform(shots, lambda s: F.when(s["outcome"] == "goal", s.withField("outcome", F.lit("save"))).otherwise(s))
    ).otherwise(shots)


def _n_goals(shots: Column) -> Column:
    return F.coalesce(F.size(F.filter(shots, lambda s: s["outcome"] == "goal")), F.lit(0))


def clean_shots(df: DataFrame) -> DataFrame:
    """Cut the shot list to the shot count; without goals no shot is one."""
    ts = F.col("shot_timestamps")
    x = df.withColumn("truncated", F.coalesce(F.size(ts) > F.col("shots"), F.lit(False)))
    x = x.withColumn("shot_timestamps", F.when(F.col("truncated"), F.slice(ts, F.lit(1), F.greatest(F.col("shots"), F.lit(0)))).otherwise(ts))
    x = x.withColumn("demoted", F.when(F.col("goals") == 0, _n_goals(ts)).otherwise(F.lit(0)))
    return x.withColumn("shot_timestamps", _demote(ts, F.col("goals") == 0))


def prune_shots(df: DataFrame) -> DataFrame:
    """Drop shots that break the evidence rules, then rebuild the counts.

    Not travelling to the net, held or passed, or neither seen nor heard: each
    only when stated.  Entries without any of the four answers stay.
    """
    f = lambda s, k: s[f"feature_puck_{k}"]
    legacy = lambda s: (
        f(s, "traveling_toward_net").isNull() & f(s, "release_frame_visible").isNull()
        & f(s, "impact_sound_audible").isNull() & f(s, "carrier_holds_or_passes").isNull()
    )
    no = lambda c: c.eqNullSafe(F.lit(False))
    yes = lambda c: c.eqNullSafe(F.lit(True))
    required = lambda s: ~legacy(s) & no(f(s, "traveling_toward_net"))
    held = lambda s: ~legacy(s) & ~no(f(s, "traveling_toward_net")) & yes(f(s, "carrier_holds_or_passes"))
    unseen = lambda s: (
        ~legacy(s) & ~no(f(s, "traveling_toward_net")) & ~yes(f(s, "carrier_holds_or_passes"))
        & no(f(s, "release_frame_visible")) & no(f(s, "impact_sound_audible"))
    )
    ts = F.col("shot_timestamps")
    n = lambda p: F.coalesce(F.size(F.filter(ts, p)), F.lit(0))
    x = df.withColumns({"pruned_required": n(required), "pruned_disqualifier": n(held), "pruned_no_evidence": n(unseen)})
    any_ = F.col("pruned_required") + F.col("pruned_disqualifier") + F.col("pruned_no_evidence") > 0
    x = x.withColumn("__any", any_)
    x = x.withColumn("shot_timestamps", F.filter(ts, lambda s: ~(required(s) | held(s) | unseen(s))))
    x = x.withColumn("shots", F.when(F.col("__any"), F.size("shot_timestamps")).otherwise(F.col("shots")))
    x = x.withColumn("sog", F.when(F.col("__any"), F.least("sog", "shots")).otherwise(F.col("sog")))
    x = x.withColumn("goals", F.when(F.col("__any"), F.least("goals", "sog")).otherwise(F.col("goals")))
    saves = F.greatest(F.col("sog") - F.col("goals"), F.lit(0))
    return x.withColumn("saves", F.when(F.col("__any"), saves).otherwise(F.col("saves"))).drop("__any")


def downgrade_goals(df: DataFrame, claimed: str = "goals") -> DataFrame:
    """A claimed goal needs a concrete description, else it was a save."""
    detail = F.trim(F.coalesce(F.col("goal_criteria.confirming_detail"), F.lit("")))
    drop = (F.col(claimed) >= 1) & ((detail == "") | is_generic(detail))
    x = df.withColumn("downgraded", F.coalesce(drop, F.lit(False)))
    x = x.withColumn("shot_timestamps", _demote(F.col("shot_timestamps"), F.col("downgraded")))
    x = x.withColumn("saves", F.when(F.col("downgraded"), F.greatest(F.col("sog"), F.lit(0))).otherwise(F.col("saves")))
    return x.withColumn("goals", F.when(F.col("downgraded"), F.lit(0)).otherwise(F.col("goals")))


def criteria_hits(df: DataFrame) -> DataFrame:
    """Names of the goal anchors and supports that are set."""
    hit = lambda names: F.array_compact(F.array(*[F.when(F.col(f"goal_criteria.{k}"), F.lit(k)) for k in names]))
    return df.withColumn("anchors", hit(ANCHORS)).withColumn("supports", hit(SUPPORTS))


def clean_metrics(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Full clean-up of metric replies, one projection per row."""
    x = fix_identity(parse_metrics(df, raw)).withColumn("claimed_goals", F.col("goals"))
    return criteria_hits(downgrade_goals(prune_shots(clean_shots(x)), "claimed_goals"))


def rule_hits(cleaned: DataFrame) -> DataFrame:
    """How often each clean-up rule fired, per recording."""
    n = F.count_if
    return cleaned.groupBy("vid").agg(
        F.count("*").alias("replies"),
        n(F.col("parse_state") == "recovered").alias("recovered"),
        n(F.col("parse_state") == "failed").alias("failed"),
        n("fixed_identity").alias("fixed_identity"),
        n("truncated").alias("truncated"),
        F.sum("demoted").alias("demoted"),
        F.sum("pruned_required").alias("pruned_required"),
        F.sum("pruned_disqualifier").alias("pruned_disqualifier"),
        F.sum("pruned_no_evidence").alias("pruned_no_evidence"),
        n("downgraded").alias("downgraded"),
    )


# -- gating -------------------------------------------------------------------


def null_metrics(gated: DataFrame) -> DataFrame:
    """Zero metrics and a marker for windows the gate skipped."""
    zero = F.struct(
        *[F.lit(0).alias(k) for k in ("shots", "shotsOnNet", "saves", "goals")],
        F.expr(f"cast(array() as array<{SHOT}>)").alias("shot_timestamps"),
        F.lit(True).alias("prefilter_skip"), F.bround("peak", 4).alias("prefilter_peak_conf"),
    )
    return gated.withColumn("metrics", F.when(F.col("skip"), zero))


def screen_skip(df: DataFrame, min_conf: float = 0.70) -> DataFrame:
    """Skip only on a confident, successful screening without any activity."""
    skip = ~F.col("failed") & ~F.col("shots_any") & ~F.col("goal_likely") & (F.col("confidence") >= min_conf)
    return df.withColumn("skip", F.coalesce(skip, F.lit(False)))


def with_metrics(seg: DataFrame, metrics: DataFrame) -> DataFrame:
    """Every segment; analysed ones carry their metrics, the others null."""
    return seg.join(metrics.select("vid", "seg_id", "metrics"), ["vid", "seg_id"], "left")


# -- voting -------------------------------------------------------------------


def resolve_votes(calls: DataFrame, shots_over: int = 4, quorum: int = 2) -> DataFrame:
    """Combine the repeated calls of a segment.

    More than ``shots_over`` shots in the first call: lower medians.  A goal in
    the first call stays only with ``quorum`` yes votes.  ``percentile_disc``
    takes the lower middle value and merges partial counts.
    """
    lower = lambda c: f"percentile_disc(0.5) within group (order by {c})"
    g = calls.groupBy("seg_id").agg(
        F.min_by(F.struct("shots", "sog", "saves", "goals"), "call_no").alias("__f"),
        F.count("*").alias("n_calls"),
        F.expr(lower("shots")).cast("int").alias("__ms"),
        F.expr(lower("sog")).cast("int").alias("__mg"),
        F.count_if(F.col("goals") >= 1).alias("yes_votes"),
    )
    first = F.col("__f")
    shot_vote, goal_vote = first["shots"] > shots_over, first["goals"] >= 1
    voted = (F.col("n_calls") > 1) & (shot_vote | goal_vote)
    use_median = voted & shot_vote
    shots = F.when(use_median, F.col("__ms")).otherwise(first["shots"])
    goals = F.when(voted & goal_vote & (F.col("yes_votes") < quorum), F.lit(0)).otherwise(first["goals"])
    sog0 = F.when(use_median, F.least("__mg", "__ms")).otherwise(first["sog"])
    sog = F.when(voted, F.greatest(sog0, goals)).otherwise(sog0)
    saves = F.when(voted, F.greatest(sog - goals, F.lit(0))).otherwise(first["saves"])
    lone = F.lit("extras_failed")
    outcome = F.when(goal_vote, F.when(F.col("n_calls") == 1, lone).when(F.col("yes_votes") >= quorum, "kept").otherwise("rejected"))
    shot_outcome = F.when(shot_vote, F.when(F.col("n_calls") == 1, lone).otherwise("applied"))
    return g.select(
        "seg_id", "n_calls", shots.alias("shots"), sog.alias("sog"), saves.alias("saves"), goals.alias("goals"),
        shot_vote.alias("shot_vote_triggered"), goal_vote.alias("goal_vote_triggered"),
        shot_outcome.alias("shot_vote_outcome"), outcome.alias("goal_vote_outcome"),
    )


def vote_summary(votes: DataFrame) -> DataFrame:
    n = F.count("*")
    pct = lambda c: F.bround(100.0 * F.count_if(c) / n, 1)
    return votes.agg(
        n.alias("n_segments"), F.sum("n_calls").alias("total_calls"), F.bround(F.sum("n_calls") / n, 3).alias("cost_ratio"),
        F.count_if("shot_vote_triggered").alias("shot_vote_fired"), pct("shot_vote_triggered").alias("shot_vote_pct"),
        F.count_if("goal_vote_triggered").alias("goal_vote_fired"), pct("goal_vote_triggered").alias("goal_vote_pct"),
        F.count_if(F.col("goal_vote_outcome") == "kept").alias("goal_vote_kept"),
        F.count_if(F.col("goal_vote_outcome") == "rejected").alias("goal_vote_rejected"),
    )


# -- totals and calibration ---------------------------------------------------


def game_totals(clips: DataFrame, gt: DataFrame | None = None) -> DataFrame:
    """Predicted totals per recording with truth totals and deltas.

    Truth counts Shots rows as shots on goal; saves are the rest after goals.
    """
    keys = ("shots", "sog", "saves", "goals")
    p = clips.groupBy("vid").agg(*[F.sum(F.coalesce(F.col(k), F.lit(0))).alias(k) for k in keys])
    if gt is None:
        return p
    t = gt.groupBy("vid").agg(
        F.count_if(F.col("action") == "Shots").alias("gt_sog"), F.count_if(F.col("action") == "Goals").alias("gt_goals")
    )
    t = t.withColumn("gt_shots", F.col("gt_sog")).withColumn("gt_saves", F.greatest(F.col("gt_sog") - F.col("gt_goals"), F.lit(0)))
    x = p.join(t, "vid", "left")
    return x.select("vid", *keys, *[f"gt_{k}" for k in keys], *[(F.col(k) - F.col(f"gt_{k}")).alias(f"delta_{k}") for k in keys])


def rolling_median(log: DataFrame, n: int = 5) -> DataFrame:
    """True median of the last ``n`` deltas per recording and field.

    ``log`` has ``(vid, field, delta, ts, event_id)``.
    """
    w = W.partitionBy("vid", "field").orderBy(F.desc("ts"), F.desc("event_id"))
    last = log.filter("delta is not null").withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= n)
    return last.groupBy("vid", "field").agg(F.median("delta").alias("median_delta"))


def calibrate(log: DataFrame, pred: DataFrame, n: int = 5) -> DataFrame:
    """Subtract the rolling median over-count, half-even, not below zero.

    ``pred`` has ``(vid, field, value)``.
    """
    x = pred.join(rolling_median(log, n), ["vid", "field"], "left")
    fixed = F.greatest(F.bround(F.col("value") - F.col("median_delta"), 0), F.lit(0)).cast("long")
    return x.withColumn("calibrated", F.coalesce(fixed, F.col("value").cast("long")))


# -- refinement ---------------------------------------------------------------


def refine(df: DataFrame, pre: int = 8, post: int = 8, min_width: int = 15) -> DataFrame:
    """Tighten a segment around its shots, at least ``min_width`` wide.

    Input has ``threat, start_s, end_s, shot_timestamps`` (null when the
    metrics are missing; ``has_metrics`` tells both cases apart).
    """
    s, e = F.col("start_s"), F.col("end_s")
    offsets = F.filter(F.transform("shot_timestamps", lambda t: parse_mmss(F.coalesce(t["timestamp"], F.lit("")))), lambda o: o.isNotNull())
    x = df.withColumn("__ts", F.transform(offsets, lambda o: F.greatest(F.least(s + o, e), s)))
    src = (
        F.when(~F.coalesce("threat", F.lit(False)), "fallback_not_threat")
        .when(s.isNull() | e.isNull(), "fallback_missing_bounds")
        .when(~F.col("has_metrics"), "fallback_no_metrics")
        .when(F.coalesce(F.size("shot_timestamps"), F.lit(0)) <= 0, "fallback_no_shots")
        .when(F.size("__ts") == 0, "fallback_unparseable")
        .otherwise("shot_timestamps")
    )
    x = x.withColumn("refinement_source", src)
    x = x.withColumn("__a", F.greatest(s, F.array_min("__ts") - pre)).withColumn("__b", F.least(e, F.array_max("__ts") + post))
    lack = F.lit(min_width) - (F.col("__b") - F.col("__a"))
    x = x.withColumn("__pb", F.floor(lack / 2).cast("int")).withColumn("__pa", (lack - F.col("__pb")).cast("int")).withColumn("__lack", lack)
    x = x.withColumn("__na", F.greatest(s, F.col("__a") - F.col("__pb"))).withColumn("__nb", F.least(e, F.col("__b") + F.col("__pa")))
    used_b, used_a = F.col("__a") - F.col("__na"), F.col("__nb") - F.col("__b")
    x = x.withColumn("__nb2", F.when(used_b < F.col("__pb"), F.least(e, F.col("__nb") + F.col("__pb") - used_b)).otherwise(F.col("__nb")))
    x = x.withColumn("__na2", F.when(used_a < F.col("__pa"), F.greatest(s, F.col("__na") - (F.col("__pa") - used_a))).otherwise(F.col("__na")))
    ok, narrow = F.col("refinement_source") == "shot_timestamps", F.col("__lack") > 0
    return (
        x.withColumn("start_refined", F.when(ok, F.when(narrow, F.col("__na2")).otherwise(F.col("__a"))).otherwise(s).cast("int"))
        .withColumn("end_refined", F.when(ok, F.when(narrow, F.col("__nb2")).otherwise(F.col("__b"))).otherwise(e).cast("int"))
        .select(*df.columns, "start_refined", "end_refined", "refinement_source")
    )


def refine_summary(refined: DataFrame) -> DataFrame:
    """Width changes and medians per recording, threats only."""
    widths = [(F.col("end_s") - F.col("start_s")).alias("__ow"), (F.col("end_refined") - F.col("start_refined")).alias("__rw")]
    x = cut(refined.filter("threat").select("vid", *widths, "refinement_source"))
    ok = F.col("refinement_source") == "shot_timestamps"
    d = F.when(ok, F.col("__rw") - F.col("__ow"))
    plain = x.groupBy("vid").agg(
        F.count("*").alias("n_threats"), F.count_if(ok).alias("n_refined"), F.avg(d).alias("avg_width_delta"),
        F.min(d).alias("min_width_delta"), F.max(d).alias("max_width_delta"),
    )
    both = plain.join(medians(x, "__ow", ["vid"], "orig_width_median"), "vid", "left").join(medians(x, "__rw", ["vid"], "refined_width_median"), "vid", "left")
    return both.withColumn("median_shrinkage", F.col("orig_width_median") - F.col("refined_width_median"))


def refine_sources(refined: DataFrame) -> DataFrame:
    return refined.groupBy("vid", "refinement_source").agg(F.count("*").alias("n"))


# -- logged goals -------------------------------------------------------------


#: metrics block of a goal the detection missed
MISSED_GOAL = (
    "named_struct('shots', 1, 'shotsOnNet', 1, 'saves', 0, 'goals', 1, 'rebounds', 0, 'observed_goalie_side', threat_goalie_side, "
    "'goal_criteria', cast(map() as map<string, boolean>), 'shot_timestamps', cast(array() as array<struct<timestamp: string>>))"
)


def claims(goals: DataFrame, clips: DataFrame, block: int = BLOCK, rounds: int = ROUNDS) -> DataFrame:
    """The clip each goal claims: ``(vid, goal_no, seg_id)``, claimed goals only.

    Goals choose in the order of ``goal_no``, each the free clip it overlaps most (closed
    ends, first on ties).  The serial order equals rounds of proposals: each goal proposes
    to its best clip that has not refused it, each clip holds the earliest goal and
    refuses later ones for good; when no clip has two proposals, all hold.  Cascades, in
    which each refusal causes the next, are finished by an ordered scan.

    ``goals``: ``vid, goal_no, a, b``; ``clips``: ``vid, seg_id, c, d``.
    """
    pairs = span_join(goals, clips, ["vid"], ("a", "b"), ("c", "d"), block)
    overlap = F.least("b", "d") - F.greatest("a", "c")
    rest = pairs.select("vid", "goal_no", "seg_id", F.struct((-overlap).alias("ov"), "seg_id").alias("__o"))
    by_goal, by_clip = W.partitionBy("vid", "goal_no"), W.partitionBy("vid", "seg_id")
    for _ in range(rounds):
        x = rest.withColumn("__best", F.min("__o").over(by_goal) == F.col("__o"))
        x = x.withColumn("__held", F.min(F.when(F.col("__best"), F.col("goal_no"))).over(by_clip))
        x = x.withColumn("__many", F.count_if("__best").over(by_clip) > 1)
        x = cut(x.filter(F.col("__held").isNull() | (F.col("goal_no") <= F.col("__held"))).drop("__held"))
        if x.filter("__best and __many").isEmpty():
            return x.filter("__best").select("vid", "goal_no", "seg_id")
        rest = x.drop("__best", "__many")
    return ordered_scan(rest.withColumn("__o", F.struct("goal_no", "__o")), "goal_no", "seg_id")


def reconcile(seg: DataFrame, goals: DataFrame, sides: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Match logged goals to threat clips; returns ``(segments, goals)``.

    In list order each goal claims a free clip (``claims``), which becomes a confirmed
    goal; otherwise a segment is injected at the goal, with the recording's goalie side
    (``sides``: ``vid, goalie_side``; else ``unknown``) and a metrics block of one goal.
    Other goal clips of a recording with logged goals are flagged as unconfirmed.  Only
    threat clips with metrics (``has_metrics``, if the column is there) can be claimed or flagged.

    ``seg``: ``vid, seg_id, start_s, end_s, threat, goals``; ``goals``: ``vid,
    goal_no, start_time, end_time``; a goal without two finite times has no verdict.
    """
    sid = dict(seg.dtypes)["seg_id"]
    times = [F.col(c).cast("double") for c in ("start_time", "end_time")]
    finite = [t.isNotNull() & (F.abs(t) < float("inf")) for t in times]
    timed = goals.filter(finite[0] & finite[1]).select("vid", "goal_no", F.least(*times).alias("a"), F.greatest(*times).alias("b"))
    clip = F.col("threat") & F.col("has_metrics")
    seg = seg if "has_metrics" in seg.columns else seg.withColumn("has_metrics", F.lit(True))
    bounds = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in ("start_s", "end_s")]
    clips = seg.filter(clip).select("vid", "seg_id", bounds[0].alias("c"), bounds[1].alias("d"))
    won = cut(claims(timed, clips))

    hit = won.select("vid", "seg_id", F.lit(True).alias("__hit"))
    any_goal = goals.select("vid").distinct().withColumn("__logged", F.lit(True))
    s = seg.join(hit, ["vid", "seg_id"], "left").join(any_goal, "vid", "left")
    claimed = F.coalesce("__hit", F.lit(False))
    kept = s.select(
        "vid", "seg_id", "start_s", "end_s", "threat", F.when(claimed, F.greatest("goals", F.lit(1))).otherwise(F.col("goals")).alias("goals"),
        F.lit(True).alias("was_ai_detected"), claimed.alias("manually_verified"),
        (F.coalesce("__logged", F.lit(False)) & clip & (F.col("goals") > 0) & ~claimed).alias("goal_unconfirmed"),
        F.expr("cast(array() as array<string>)").alias("source_signals"),
        *[F.col(c) for c in ("threat_goalie_side",) if c in seg.columns],
    )
    verdict = goals.select("vid", "goal_no").join(won.select("vid", "goal_no", F.lit(True).alias("__hit")), ["vid", "goal_no"], "left")
    verdict = verdict.join(timed, ["vid", "goal_no"], "left").withColumn("was_ai_detected", F.when(F.col("a").isNotNull(), F.coalesce("__hit", F.lit(False))))
    lost = verdict.filter("not was_ai_detected")
    if sides is None:
        lost = lost.withColumn("goalie_side", F.lit(None).cast("string"))
    else:
        lost = lost.join(sides.select("vid", "goalie_side"), "vid", "left")
    injected = lost.select(
        "vid", F.lit(None).cast(sid).alias("seg_id"), F.floor("a").cast("int").alias("start_s"), F.ceil("b").cast("int").alias("end_s"),
        F.lit(True).alias("threat"), F.lit(1).alias("goals"), F.lit(False).alias("was_ai_detected"), F.lit(True).alias("manually_verified"),
        F.lit(False).alias("goal_unconfirmed"), F.array(F.lit("manual_goal")).alias("source_signals"),
        F.when(F.coalesce("goalie_side", F.lit("")) == "", "unknown").otherwise(F.col("goalie_side")).alias("threat_goalie_side"),
    )
    injected = injected.withColumn("metrics", F.expr(MISSED_GOAL))
    return kept.unionByName(injected, allowMissingColumns=True), goals.join(verdict.select("vid", "goal_no", "was_ai_detected"), ["vid", "goal_no"], "left")


# -- feedback replies ---------------------------------------------------------

# Fixed schema of a feedback reply; scores stay text so that booleans show.
FEEDBACK = (
    "technical_reasoning string, goalie_positioning struct<depth_rank:string,cover_angle_rank:string,squareness_rank:string,"
    "goalie_position_confidence_score:string>, coaching_feedback struct<rebound_control_rank:string,"
    "actionable_coaching_feedback:string,coaching_confidence_score:string>, analysis_confidence_caveats array<string>"
)


def validate_clip(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Decode and normalise feedback replies; ``errors`` lists what is wrong."""
    x = once(once(df, "__t", recover_json(F.col(raw))), "__d", F.from_json(F.col("__t"), FEEDBACK))
    pos, fb = F.col("__d.goalie_positioning"), F.col("__d.coaching_feedback")
    got = F.struct(
        pos["depth_rank"].alias("d"), pos["cover_angle_rank"].alias("a"), pos["squareness_rank"].alias("s"), fb["rebound_control_rank"].alias("r")
    )
    fixed = F.struct(
        clean_enum(F.col("__g.d"), "depth").alias("d"), clean_enum(F.col("__g.a"), "quality").alias("a"),
        clean_enum(F.col("__g.s"), "quality").alias("s"), clean_enum(F.col("__g.r"), "rebound").alias("r"),
    )
    x = once(once(x, "__g", got), "__e", fixed)
    x = x.select(
        *[c for c in df.columns if c != raw], F.col("__d").isNull().alias("__bad"),
        F.col("__e.d").alias("depth_rank"), F.col("__e.a").alias("cover_angle_rank"),
        F.col("__e.s").alias("squareness_rank"), F.col("__e.r").alias("rebound_control_rank"),
        normalize_conf(pos["goalie_position_confidence_score"]).alias("position_confidence"),
        normalize_conf(fb["coaching_confidence_score"]).alias("coaching_confidence"),
        F.coalesce("__d.analysis_confidence_caveats", F.expr("cast(array() as array<string>)")).alias("caveats"),
    )
    need = ("depth_rank", "cover_angle_rank", "squareness_rank", "rebound_control_rank", "position_confidence", "coaching_confidence")
    bad = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in need]))
    return x.withColumn("errors", F.when(F.col("__bad"), F.array(F.lit("unparseable"))).otherwise(bad)).drop("__bad")


def valid_clips(v: DataFrame) -> DataFrame:
    return v.filter(F.size("errors") == 0).drop("errors")


def rejected_clips(v: DataFrame) -> DataFrame:
    return v.filter(F.size("errors") > 0)


def reject_reasons(v: DataFrame) -> DataFrame:
    return v.select(F.explode("errors").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def clip_record(df: DataFrame) -> DataFrame:
    """Derived clip columns; missing counts read as zero."""
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    return df.withColumns(
        {
            "clip_id": clip_id(F.col("vid"), F.col("start_s"), F.col("end_s")),
            "clip_duration": F.col("end_s") - F.col("start_s"),
            "clip_shot": n("shots") > 0,
            "clip_shot_count": n("shots"),
            "clip_save": n("saves") > 0,
            "clip_save_count": n("saves"),
            "clip_has_goal": n("goals") > 0,
        }
    )


def rating(clips: DataFrame) -> DataFrame:
    """Game rating from label shares: start 60, bonuses and penalties, 0-100."""
    share = lambda c, *labels: F.avg(F.when(F.col(c).isin(*labels), 1.0).otherwise(0.0))
    g = clips.groupBy("vid").agg(
        share("depth_rank", "Aggressive (A)", "Base (B)").alias("d"),
        share("cover_angle_rank", "Excellent", "Good").alias("a"),
        share("squareness_rank", "Excellent", "Good").alias("q"),
        share("rebound_control_rank", "Killed (Elite)", "Steered to Low-Danger Zone").alias("r"),
        F.count_if(F.col("rebound_control_rank") == "Goal Allowed").alias("allowed"),
        share("cover_angle_rank", "Poor").alias("pa"),
        share("squareness_rank", "Poor").alias("pq"),
    )
    bonus = lambda c, n: F.when(F.col(c) >= 0.6, n).otherwise(0)
    score = 60 + bonus("d", 10) + bonus("a", 10) + bonus("q", 10) + bonus("r", 5) - 5 * F.col("allowed")
    score = score - F.when((F.col("pa") >= 0.3) | (F.col("pq") >= 0.3), 5).otherwise(0)
    return g.select("vid", F.concat(F.greatest(F.least(score, F.lit(100)), F.lit(0)).cast("string"), F.lit("%")).alias("rating"))


def game_summary(clips: DataFrame) -> DataFrame:
    """Success counts per recording."""
    return clips.groupBy("vid").agg(
        F.count("*").alias("windows_analysed"), F.count_if(F.col("error").isNull()).alias("windows_succeeded"),
        F.count_if(F.col("error").isNotNull()).alias("windows_failed"),
    )


def game_document(clips: DataFrame) -> DataFrame:
    """A recording's published document as rows: one summary, then its windows.

    Windows stay rows (ordered by ``pos``) instead of one array per recording,
    so no recording is gathered in memory.
    """
    summary = game_summary(clips)
    head = summary.select("vid", F.lit("summary").alias("type"), F.lit(-1).alias("pos"), F.to_json(F.struct(*summary.columns)).alias("response"))
    body = clips.select("vid", F.lit("windows").alias("type"), F.col("start_s").cast("int").alias("pos"), F.to_json(F.struct(*clips.columns)).alias("response"))
    return head.unionByName(body)
