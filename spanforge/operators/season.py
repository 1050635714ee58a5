"""Season statistics over clip records.

Rates are always pooled: sums first, then one division.  Clips are reduced to
per-game or per-bucket sums with map-side combine before anything is ordered.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.stats import ratio, wilson

# Label scales, weights and thresholds of the season formulas.
WEAK = {
    "depth": ("depth_rank", ("Conservative (C)", "Defensive (D)"), "position_confidence"),
    "angle": ("cover_angle_rank", ("Average", "Poor"), "position_confidence"),
    "squareness": ("squareness_rank", ("Average", "Poor"), "position_confidence"),
    "rebound": ("rebound_control_rank", ("Uncontrolled into High-Danger Zone", "Goal Allowed"), "coaching_confidence"),
}
QUALITY = {"Excellent": 3.0, "Good": 2.0, "Average": 1.0, "Poor": 0.0}
REBOUND = {"Killed (Elite)": 3.0, "Steered to Low-Danger Zone": 2.0, "Uncontrolled into High-Danger Zone": 1.0, "Goal Allowed": 0.0}
DEPTH_BEST = {"Base (B)": 0.0, "Aggressive (A)": 1.0, "Conservative (C)": 2.0, "Defensive (D)": 3.0}
GRADE = {
    "depth": ("depth_rank", {"Aggressive (A)": 100.0, "Base (B)": 85.0, "Conservative (C)": 65.0, "Defensive (D)": 45.0}, "position_confidence"),
    "angle": ("cover_angle_rank", {"Excellent": 100.0, "Good": 80.0, "Average": 60.0, "Poor": 40.0}, "position_confidence"),
    "squareness": ("squareness_rank", {"Excellent": 100.0, "Good": 80.0, "Average": 60.0, "Poor": 40.0}, "position_confidence"),
    "rebound": (
        "rebound_control_rank",
        {"Killed (Elite)": 100.0, "Steered to Low-Danger Zone": 75.0, "Uncontrolled into High-Danger Zone": 40.0, "Goal Allowed": 10.0},
        "coaching_confidence",
    ),
}
PILLARS = tuple(GRADE)
ZONES = ("glove_high", "glove_low", "blocker_high", "blocker_low", "five_hole", "body_other", "unknown")
CUES = "breakaway|rush|odd-man|2-on-1|3-on-2|cross-ice|royal road|backdoor|wide open|in alone"


def scale(c: str | Column, values: dict[str, float]) -> Column:
    """Label to number; unknown labels stay null."""
    col = F.col(c) if isinstance(c, str) else c
    out = F.lit(None).cast("double")
    for label, v in values.items():
        out = F.when(col == label, F.lit(v)).otherwise(out)
    return out


# -- confidence and review -----------------------------------------------------


def clip_confidence(df: DataFrame) -> DataFrame:
    """Weighted mean of the present confidences, cut by caveats, in bands."""
    unit = lambda v: F.when(v.isNotNull(), F.greatest(F.least(v, F.lit(1.0)), F.lit(0.0)))
    five = lambda c: unit((F.col(c) - 1) / 4)
    parts = [
        (five("position_confidence"), 0.45),
        (five("coaching_confidence"), 0.35),
        (F.when(F.col("goals") > 0, unit(F.col("beaten_confidence"))), 0.20),
    ]
    num = sum((F.coalesce(v * w, F.lit(0.0)) for v, w in parts), F.lit(0.0))
    den = sum((F.when(v.isNotNull(), w).otherwise(0.0) for v, w in parts), F.lit(0.0))
    score = F.when(den > 0, num / den).otherwise(F.lit(0.5)) * F.when(F.col("n_caveats") > 0, 0.85).otherwise(1.0)
    x = df.withColumn("confidence", score)
    band = F.when(F.col("confidence") >= 0.70, "high").when(F.col("confidence") >= 0.45, "medium").otherwise("low")
    return x.withColumn("band", band).withColumn("needs_review", F.col("band") == "low")


def verification(clips: DataFrame, reviews: DataFrame, key: str = "clip_id") -> DataFrame:
    """State of each clip after its latest review (later position on ties)."""
    last = reviews.filter(F.col("type").isin("Accurate", "Correction")).groupBy(key).agg(F.max_by("type", F.struct("ts", "pos")).alias("__last"))
    state = F.when(F.col("__last") == "Accurate", "verified").when(F.col("__last") == "Correction", "corrected").otherwise("unreviewed")
    return clips.join(last, key, "left").withColumn("state", state).drop("__last")


def verified_pct(states: DataFrame, by: str = "vid") -> DataFrame:
    """Verified share per game and pooled over all (``by`` null)."""
    n = lambda s: F.count_if(F.col("state") == s)
    x = states.rollup(by).agg(n("verified").alias("verified"), n("corrected").alias("corrected"), n("unreviewed").alias("unreviewed"), F.count("*").alias("total"))
    return x.withColumn("verified_pct", F.bround(100.0 * F.col("verified") / F.greatest("total", F.lit(1)), 0))


def review_queue(states: DataFrame) -> DataFrame:
    """Review priority; unreviewed clips come first, then the highest."""
    p, c = F.coalesce("position_confidence", F.lit(3)), F.coalesce("coaching_confidence", F.lit(3))
    prio = F.when(F.col("n_caveats") > 0, 100).otherwise(0) + (5 - F.least(p, c)) * 10 + (5 - (p + c) / 2)
    x = states.withColumn("priority", prio).withColumn("reviewed", F.col("state") != "unreviewed")
    return x.orderBy("reviewed", F.desc("priority"))


# -- leaks ---------------------------------------------------------------------


def leaks(clips: DataFrame, by: Sequence[str] = ("season",), k: int = 5) -> DataFrame:
    """Weak spots that cost goals, ranked per scope.

    Each dimension's weak clips are compared with the scope's own goal rate,
    overall and by side.  A side's clips are a subset of the overall ones, so
    their Jaccard overlap is the ratio of the two counts.
    """
    by = list(by)
    x = clips.filter("goals > 0 or saves > 0").withColumn("__g", (F.col("goals") > 0).cast("int"))
    rows = F.array(
        *[
            F.struct(F.lit(d).alias("dimension"), F.coalesce(F.col(conf), F.lit(3)).alias("conf"), F.col(c).isin(*weak).alias("weak"))
            for d, (c, weak, conf) in WEAK.items()
        ]
    )
    base = x.groupBy(*by).agg(F.count("*").alias("n_total"), F.sum("__g").alias("goals_total"))
    w = x.select(*by, "side", "__g", F.explode(rows).alias("r")).filter("r.weak").select(*by, "side", "__g", "r.dimension", "r.conf")
    part = w.groupBy(*by, "dimension", "side").agg(F.count("*").alias("n"), F.sum("__g").alias("g"), F.sum("conf").alias("c"), F.sum(F.col("__g") * F.col("conf")).alias("gc"))
    both = F.array(F.lit("all"), F.when(F.col("side").isin("left", "right"), F.col("side")))
    part = part.withColumn("scope", F.explode(F.array_compact(both)))
    cand = part.groupBy(*by, "dimension", "scope").agg(F.sum("n").alias("n_leak"), F.sum("g").alias("goals_leak"), F.sum("c").alias("__c"), F.sum("gc").alias("__gc"))
    cand = cand.join(base, by)
    rate = F.col("goals_total") / F.col("n_total")
    cand = cand.withColumn("base_rate", rate).withColumn("leak_rate", F.col("goals_leak") / F.col("n_leak"))
    # each clip counts by its confidence
    cand = cand.withColumn("weighted_leak_rate", F.col("__gc") / F.col("__c"))
    cand = cand.withColumn("rr", F.col("leak_rate") / F.greatest("base_rate", F.lit(0.05))).withColumn("avg_conf", F.col("__c") / F.col("n_leak") / 5)
    cand = cand.withColumn("excess_goals", F.col("goals_leak") - F.col("n_leak") * F.col("base_rate"))
    cand = cand.withColumn("score", F.col("excess_goals") * F.log2("rr") * F.col("avg_conf")).withColumn("hint", F.col("avg_conf") < 0.5)
    return cand.drop("__c", "__gc")


def promoted_leaks(cand: DataFrame, by: Sequence[str] = ("season",), k: int = 5, min_rr: float = 1.5) -> DataFrame:
    """Candidates passing the sample and elevation guards, de-duplicated, top ``k``."""
    by = list(by)
    need = F.when(F.col("scope") == "all", 5).otherwise(6)
    ok = cand.filter((F.col("n_leak") >= need) & (F.col("goals_leak") >= 3) & (F.col("rr") >= min_rr) & (F.col("base_rate") >= 0.05))
    w = W.partitionBy(*by, "dimension")
    all_ = lambda c: F.max(F.when(F.col("scope") == "all", F.col(c))).over(w)
    x = ok.withColumn("__an", all_("n_leak")).withColumn("__as", all_("score"))
    near = (F.col("scope") != "all") & (F.col("n_leak") / F.col("__an") > 0.6)
    side_wins = F.col("score") >= 0.9 * F.col("__as")
    x = x.withColumn("__beats", near & side_wins).withColumn("__lose", near & ~side_wins)
    x = x.withColumn("__out", F.max("__beats").over(w))
    x = x.filter(~F.coalesce("__lose", F.lit(False)) & ~((F.col("scope") == "all") & F.coalesce("__out", F.lit(False))))
    r = F.row_number().over(W.partitionBy(*by).orderBy(F.desc("score"), "dimension", "scope"))
    return x.withColumn("rank", r).filter(F.col("rank") <= k).drop("__an", "__as", "__beats", "__lose", "__out")


# -- danger --------------------------------------------------------------------


def shot_danger(shots: DataFrame) -> DataFrame:
    """Danger tier of each shot from location, release and text cues."""
    has = lambda c, *words: F.lower(F.col(c)).rlike("|".join(words))
    base = (
        F.when(has("location", "in close", "low slot", "high slot", "slot"), 3)
        .when(has("location", "circle", "wing"), 2)
        .when(has("location", "point", "behind net"), 1)
        .otherwise(2)
    )
    quick = has("release", "one-timer", "redirect", "tip")
    up = F.when(quick, F.when(base >= 2, 3).otherwise(2)).otherwise(base)
    up = up + F.when((F.col("outcome") == "save") & (F.col("rebounds") > 0), 1).otherwise(0)
    up = F.least(up, F.lit(3)) + F.when(F.lower(F.col("text")).rlike(CUES), 1).otherwise(0)
    tier = F.element_at(F.array(F.lit("low"), F.lit("medium"), F.lit("high")), F.least(up, F.lit(3)).cast("int"))
    return shots.withColumn("danger", tier)


def clip_danger(clips: DataFrame, text: str = "cue_text") -> DataFrame:
    """Clip-level tier where single shots are unknown."""
    tier = (
        F.when(F.col("goals") > 0, "high").when(F.col("rebounds") > 0, "high").when(F.col("sog") < F.col("shots"), "medium")
        .when(F.lower(F.col(text)).rlike(CUES), "high").otherwise("medium")
    )
    return clips.withColumn("danger", tier)


def approx_period(df: DataFrame, n: int = 3, start: str = "start_s", end: str = "end_s", by: str = "vid") -> DataFrame:
    """Period from the position of the clip start in the game's span."""
    span = df.groupBy(by).agg(F.min(start).alias("__a"), F.max(end).alias("__b"))
    frac = F.when(F.col("__b") > F.col("__a"), (F.col(start) - F.col("__a")) / (F.col("__b") - F.col("__a"))).otherwise(0.0)
    p = F.greatest(F.least(F.ceil(frac * n), F.lit(n)), F.lit(1)).cast("int")
    return df.join(span, by).withColumn("period", p).drop("__a", "__b")


def danger_splits(shots: DataFrame, min_n: int = 5) -> DataFrame:
    """Save rate by tier, side and period with Wilson bounds."""
    on = shots.filter(F.col("outcome").isin("save", "goal"))
    part = on.groupBy("danger", "side", "period").agg(F.count("*").alias("n"), F.count_if(F.col("outcome") == "save").alias("saves"))
    splits = F.array(
        *[F.struct(F.lit(c).alias("split"), F.col(c).cast("string").alias("bucket")) for c in ("danger", "side", "period")]
    )
    x = part.select("n", "saves", F.explode(splits).alias("s")).groupBy("s.split", "s.bucket").agg(F.sum("n").alias("n"), F.sum("saves").alias("saves"))
    lo, hi = wilson(F.col("saves"), F.col("n"))
    return x.select("split", "bucket", "n", "saves", (F.col("saves") / F.col("n")).alias("sv_pct"), lo.alias("ci_lo"), hi.alias("ci_hi"), (F.col("n") < min_n).alias("small_sample"))


def beaten_map(clips: DataFrame) -> DataFrame:
    """Goals per zone with both shares; every zone is listed."""
    zone = F.when(F.col("beaten_location").isin(*ZONES), F.col("beaten_location")).otherwise("unknown")
    g = clips.filter("goals > 0").groupBy(zone.alias("zone")).agg(F.sum("goals").alias("goals"), F.count("*").alias("clips"))
    zones = clips.sparkSession.createDataFrame([(z,) for z in ZONES], "zone string")
    x = F.broadcast(zones).join(g, "zone", "left").na.fill(0)
    tot = x.agg(F.sum("goals").alias("__all"), F.sum(F.when(F.col("zone") != "unknown", F.col("goals"))).alias("__loc"), F.max_by("zone", F.when(F.col("zone") != "unknown", F.struct("goals", "zone"))).alias("__top"))
    x = x.withColumn("__one", F.lit(1)).join(F.broadcast(tot.withColumn("__one", F.lit(1))), "__one")
    return x.select(
        "zone", "goals", "clips", ratio(F.col("goals"), F.col("__all"), None).alias("pct_all"),
        F.when(F.col("zone") != "unknown", ratio(F.col("goals"), F.col("__loc"), None)).alias("pct_located"), (F.col("zone") == F.col("__top")).alias("dominant"),
    )


def zone_clips(clips: DataFrame, by: Sequence[str] = ("vid",)) -> DataFrame:
    """The goal clips behind each zone, in time order within a scope."""
    zone = F.when(F.col("beaten_location").isin(*ZONES), F.col("beaten_location")).otherwise("unknown")
    x = clips.filter("goals > 0").select(*by, zone.alias("zone"), "clip_no", "start_s", "goals")
    return x.withColumn("pos", F.row_number().over(W.partitionBy(*by, "zone").orderBy("start_s", "clip_no")))


def zone_ranks(clips: DataFrame, rank: str = "depth_rank") -> DataFrame:
    """How a rank is distributed among the goals of each zone."""
    return clips.filter("goals > 0").groupBy(F.col("beaten_location").alias("zone"), F.col(rank).alias("rank")).agg(F.count("*").alias("n"))


# -- search --------------------------------------------------------------------

# Rank words to ordinals for search conditions.
RANK_WORDS = {"poor": 1, "average": 2, "good": 3, "elite": 4}
RANK_ORDINAL = {
    "Excellent": 4.0, "Good": 3.0, "Average": 2.0, "Poor": 1.0, "Base (B)": 4.0, "Aggressive (A)": 3.0, "Conservative (C)": 2.0, "Defensive (D)": 1.0,
    "Killed (Elite)": 4.0, "Steered to Low-Danger Zone": 3.0, "Uncontrolled into High-Danger Zone": 2.0, "Goal Allowed": 1.0,
}
RANK_COLUMN = {"depth": "depth_rank", "cover_angle": "cover_angle_rank", "squareness": "squareness_rank", "rebound_control": "rebound_control_rank"}
OUTCOMES = {"goal": "goals > 0", "save": "saves > 0", "shot": "shots > 0", "rebound": "rebounds > 0"}


def clip_search(
    clips: DataFrame,
    outcome: Sequence[str] = (),
    side: Sequence[str] = (),
    beaten: Sequence[str] = (),
    location: Sequence[str] = (),
    release: Sequence[str] = (),
    period: Sequence[int] = (),
    ranks: Sequence[tuple[str, str, str]] = (),
    cues: Sequence[str] = (),
    min_confidence: float | None = None,
) -> DataFrame:
    """All conditions must hold; values outside the known lists are ignored.

    Expects ``period`` and ``confidence`` when those conditions are used.
    """
    x = clips
    known = [o for o in outcome if o in OUTCOMES]
    if known:
        x = x.filter(" or ".join(f"({OUTCOMES[o]})" for o in known))
    for col, vals, allowed in (("side", side, ("left", "right")), ("beaten_location", beaten, ZONES)):
        ok = [v for v in vals if v in allowed]
        if ok:
            x = x.filter(F.col(col).isin(*ok))
    if location:
        x = x.filter(F.col("shot_location").isin(*location))
    if release:
        x = x.filter(F.col("release").isin(*release))
    ok_p = [p for p in period if p in (1, 2, 3)]
    if ok_p:
        x = x.filter(F.col("period").isin(*ok_p))
    for dim, op, word in ranks:
        if dim in RANK_COLUMN and op in ("<=", ">=", "==") and word in RANK_WORDS:
            v, t = scale(RANK_COLUMN[dim], RANK_ORDINAL), RANK_WORDS[word]
            x = x.filter({"<=": v <= t, ">=": v >= t, "==": v == t}[op])
    if cues:
        low = F.lower(F.col("cue_text"))
        hit = F.lit(False)
        for c in cues:
            hit = hit | F.contains(low, F.lit(c.lower()))
        x = x.filter(hit)
    return x if min_confidence is None else x.filter(F.col("confidence") >= min_confidence)


def search_counts(matched: DataFrame, min_n: int = 5) -> DataFrame:
    """Counts of a search by outcome, side, zone and period, plus the pooled save rate."""
    part = matched.groupBy("side", "beaten_location", "period").agg(
        F.count("*").alias("n"), *[F.count_if(F.expr(e)).alias(o) for o, e in OUTCOMES.items()], F.sum("saves").alias("s"), F.sum("sog").alias("d")
    )
    one = lambda kind, key, n: F.struct(F.lit(kind).alias("kind"), key.cast("string").alias("key"), n.alias("n"))
    rows = [one("total", F.lit("all"), F.col("n")), one("saves", F.lit("all"), F.col("s")), one("sog", F.lit("all"), F.col("d"))]
    rows += [one("outcome", F.lit(o), F.col(o)) for o in OUTCOMES]
    rows += [one(k, F.col(c), F.col("n")) for k, c in (("side", "side"), ("zone", "beaten_location"), ("period", "period"))]
    return part.select(F.explode(F.array(*rows)).alias("r")).groupBy("r.kind", "r.key").agg(F.sum("r.n").alias("n"))


# -- agenda and reels ------------------------------------------------------------


def _conf(c: str, default: int = 3) -> Column:
    return F.coalesce(F.col(c), F.lit(default))


def instruction_score(clips: DataFrame, week_latest: Column | None = None, date: str = "game_date", by: Sequence[str] = ("vid", "season")) -> DataFrame:
    """How much a clip teaches: events and extremes, scaled by confidence.

    Clips of low confidence are left out, unless a scope ``by`` has no other.
    """
    conf = F.least(_conf("coaching_confidence"), _conf("position_confidence")) / 5.0
    rb = scale("rebound_control_rank", REBOUND)
    rebound = F.coalesce(F.abs(rb - 1.5) / 1.5, F.lit(0.0))
    pos = (F.abs(scale("cover_angle_rank", QUALITY) - 1.5) + F.abs(scale("squareness_rank", QUALITY) - 1.5)) / 3.0
    raw = (
        4.0 * F.when(F.col("goals") > 0, 1.0).otherwise(0.0) + 2.0 * F.least(F.col("saves"), F.lit(3)) / 3.0
        + 1.0 * F.least(F.col("sog"), F.lit(3)) / 3.0 + 2.5 * rebound + 1.5 * F.coalesce(pos, F.lit(0.0))
    )
    caveat = F.when(F.col("n_caveats") > 0, 0.85).otherwise(1.0)
    recency = F.lit(1.0) if week_latest is None else F.pow(F.lit(0.5), F.datediff(week_latest, F.col(date)) / 7.0)
    x = clips.withColumn("score", raw * conf * caveat * recency)
    elite = (F.col("rebound_control_rank") == "Killed (Elite)") | (
        (F.col("saves") > 0) & ((F.col("cover_angle_rank") == "Excellent") | (F.col("squareness_rank") == "Excellent"))
    )
    kind = F.when(F.col("goals") > 0, "goal").when(elite, "elite_save").otherwise("other")
    x = x.withColumn("kind", kind).withColumn("__conf", conf)
    best = x.groupBy(*by).agg(F.max("__conf").alias("__best"))
    return x.join(best, list(by)).filter("__conf >= 0.4 or __best < 0.4").drop("__conf", "__best")


def _spread(ordered: Column, item: str, gap: int, limit: Column | None = None) -> Column:
    """Keep items in order unless one starts within ``gap`` of a kept one."""
    return F.aggregate(
        ordered, F.expr(f"cast(array() as array<{item}>)"),
        lambda acc, x: F.when(F.exists(acc, lambda y: (y["grp"] == x["grp"]) & (F.abs(y["start_s"] - x["start_s"]) <= gap)), acc).otherwise(F.array_append(acc, x)),
    )


def agenda(scored: DataFrame, n: int = 5, by: Sequence[str] = ("vid", "season"), gap: int = 2, game: str = "game", per_game: int | None = None) -> DataFrame:
    """Up to ``n`` clips per scope: two goals, two elite saves, then by score.

    A pool of several games may give at most ``per_game`` clips a game.  If all picks are
    goals, or all elite saves, and the other kind is there, the lowest gives way to
    the best of that kind.  Clips of one ``game`` that start within ``gap`` show the same
    play; the better is kept.

    Only few clips of each kind can be picked, so each scope is cut to those before
    its candidates are gathered: the best ``per_game`` of a game and kind, and of
    these ``n`` for each pick and game a pick may close.
    """
    by, cap = list(by), per_game or n
    if per_game:
        w0 = W.partitionBy(*by, game, "kind").orderBy(F.desc("score"), "clip_no")
        scored = scored.withColumn("__g", F.row_number().over(w0)).filter(F.col("__g") <= cap).drop("__g")
    w = W.partitionBy(*by, "kind").orderBy(F.desc("score"), "clip_no")
    top = scored.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= (n * (1 + cap) if per_game else n))
    item = F.struct(
        (-F.col("score")).alias("neg"), F.col("clip_no").alias("clip_no"), F.col(game).cast("string").alias("grp"), F.col("start_s").alias("start_s"), F.col("kind").alias("kind")
    )
    ty = "struct<neg:double,clip_no:bigint,grp:string,start_s:int,kind:string>"
    g = top.groupBy(*by).agg(F.array_sort(F.collect_list(item)).alias("__l"))
    of = lambda kind: F.filter("__l", lambda x: x["kind"] == kind)
    phase = lambda items, k: F.transform(items, lambda x: F.struct(F.lit(k).alias("p"), x.alias("x")))
    turns = F.concat(phase(of("goal"), 1), phase(of("elite_save"), 2), phase(F.col("__l"), 3))
    room = lambda acc, x: F.size(F.filter(acc, lambda y: y["grp"] == x["grp"])) < cap

    def pick(acc, turn):
        x = turn["x"]
        few = (turn["p"] == 3) | (F.size(F.filter(acc, lambda y: y["kind"] == x["kind"])) < 2)
        ok = (F.size(acc) < n) & few & room(acc, x) & ~F.exists(acc, lambda y: y["clip_no"] == x["clip_no"])
        return F.when(ok, F.array_append(acc, x)).otherwise(acc)

    g = g.withColumn("__p", F.array_sort(F.aggregate(turns, F.expr(f"cast(array() as array<{ty}>)"), pick)))
    rest = F.slice("__p", 1, F.greatest(F.size("__p") - 1, F.lit(0)))
    other = F.when(F.forall("__p", lambda x: x["kind"] == "goal"), of("elite_save")).when(F.forall("__p", lambda x: x["kind"] == "elite_save"), of("goal"))
    swap = F.get(F.filter(other, lambda x: F.size(F.filter(rest, lambda y: y["grp"] == x["grp"])) < cap), F.lit(0))
    g = g.withColumn("__p", F.when((F.size("__p") > 1) & swap.isNotNull(), F.array_sort(F.array_append(rest, swap))).otherwise(F.col("__p")))
    kept = g.select(*by, F.explode(_spread(F.col("__p"), ty, gap)).alias("k"))
    order = F.when(F.col("kind") == "elite_save", 0).when(F.col("kind") == "goal", 1).otherwise(2)
    x = kept.select(*by, "k.clip_no", "k.kind", "k.start_s", (-F.col("k.neg")).alias("score"))
    return x.withColumn("pos", F.row_number().over(W.partitionBy(*by).orderBy(order, F.desc("score"), "clip_no")))


def reel(
    clips: DataFrame, kind: str = "saves", by: Sequence[str] = ("vid", "season"), game: str = "game", gap: int = 2,
    cap: int | None = None, per_game: int | None = None, max_len: float | None = None, spread: str | None = None,
) -> DataFrame:
    """Highlight reel: scored, spread over games, short enough.

    Saves reel: no goals, sure positioning, best first.  Goals reel: by
    teaching value.  Games are thinned first (per-game cap and ``gap``), then
    the reel is cut by count and by total length; one clip always stays.
    """
    by = list(by)
    q = (scale("cover_angle_rank", QUALITY) + scale("squareness_rank", QUALITY)) / 2 / 3
    if kind == "saves":
        x = clips.filter((F.col("saves") > 0) & ~(F.col("goals") > 0) & (F.col("position_confidence") >= 2))
        score = (
            0.40 * F.least(F.col("saves"), F.lit(3)) / 3 + 0.25 * F.coalesce(q, F.lit(0.0))
            + 0.20 * (F.col("position_confidence") / 5) + 0.15 * (_conf("coaching_confidence") / 5)
        )
        cap, per_game, max_len = cap or 8, per_game or 3, max_len or 90.0
    else:
        x = clips.filter("goals > 0")
        rb = 1 - F.coalesce(scale("rebound_control_rank", REBOUND), F.lit(1.5)) / 3
        pos = (scale("depth_rank", DEPTH_BEST) + (3 - scale("cover_angle_rank", QUALITY)) + (3 - scale("squareness_rank", QUALITY))) / 9
        score = 0.5 * rb + 0.3 * F.coalesce(pos, F.lit(0.5)) + 0.2 * (F.least(_conf("position_confidence"), _conf("coaching_confidence")) / 5)
        cap, per_game, max_len = cap or 10, per_game or 10, max_len or 180.0
    x = x.withColumn("score", score).withColumn("spot", F.col(spread).cast("string") if spread else F.lit(None).cast("string"))
    item = F.struct(
        (-F.col("score")).alias("neg"), F.col("clip_no"), F.lit(0).alias("grp"), F.col("start_s"), (F.col("end_s") - F.col("start_s")).alias("len"), F.col("spot")
    )
    ty = "struct<neg:double,clip_no:bigint,grp:int,start_s:int,len:int,spot:string>"
    # per game: the dedupe works on start seconds, so one clip per second is enough
    best = x.groupBy(*by, game, "start_s").agg(F.max_by(F.struct("clip_no", "end_s", "score", "spot"), F.struct("score", -F.col("clip_no"))).alias("b"))
    best = best.select(*by, game, "start_s", "b.*")
    g = best.groupBy(*by, game).agg(F.array_sort(F.collect_list(item)).alias("__l"))
    kept = g.select(*by, game, F.explode(F.slice(_spread(F.col("__l"), ty, gap), 1, per_game)).alias("k"))
    kept = kept.select(*by, game, "k.clip_no", "k.start_s", "k.len", "k.spot", (-F.col("k.neg")).alias("score"))
    # the best clip of each spot comes first, then the second of each, and so on
    kept = kept.withColumn("__turn", F.row_number().over(W.partitionBy(*by, "spot").orderBy(F.desc("score"), "clip_no")) if spread else F.lit(1))
    r = W.partitionBy(*by).orderBy("__turn", F.desc("score"), "clip_no")
    top = kept.withColumn("rank", F.row_number().over(r)).filter(F.col("rank") <= cap)
    total = F.sum("len").over(r.rowsBetween(W.unboundedPreceding, 0))
    out = top.withColumn("total_len", total).filter((F.col("total_len") <= max_len) | (F.col("rank") == 1)).drop("__turn")
    # a single game is reviewed as it unfolded
    out = out.withColumn("shown", F.row_number().over(W.partitionBy(*by).orderBy("start_s", "clip_no")))
    return out if spread else out.drop("spot")


# -- report card -------------------------------------------------------------------


def game_sums(clips: DataFrame) -> DataFrame:
    """Per-game sums every season figure is built from."""
    aggs = []
    for p, (c, values, conf) in GRADE.items():
        s = scale(c, values)
        weight = F.when(s.isNotNull(), F.greatest(F.least(_conf(conf), F.lit(5)), F.lit(1)) / 5)
        aggs += [F.sum(weight * s).alias(f"{p}_ws"), F.sum(weight).alias(f"{p}_w")]
    return clips.groupBy("vid", "season", "game", "month").agg(
        *aggs, F.sum("saves").alias("saves"), F.sum("goals").alias("goals"), F.sum("sog").alias("sog"), F.count("*").alias("clips")
    )


def pillar_scores(sums: DataFrame, by: Sequence[str]) -> DataFrame:
    """Pooled pillar scores, save rate on its curve, and the weighted overall."""
    cols = [f"{p}_{k}" for p in PILLARS for k in ("ws", "w")] + ["saves", "goals", "sog", "clips"]
    x = sums.groupBy(*by).agg(*[F.sum(c).alias(c) for c in cols])
    on = F.greatest(F.col("saves") + F.col("goals"), F.col("sog"))
    x = x.withColumn("save_pct", F.when(on > 0, F.col("saves") / on))
    x = x.withColumn("save_score", F.greatest(F.least((F.col("save_pct") - 0.820) / (0.960 - 0.820) * 100, F.lit(100.0)), F.lit(0.0)))
    x = x.withColumn("save_score", F.when(F.col("save_pct").isNotNull(), F.col("save_score")))
    for p in PILLARS:
        x = x.withColumn(p, F.when(F.col(f"{p}_w") > 0, F.col(f"{p}_ws") / F.col(f"{p}_w")))
    parts = [F.col(p) for p in PILLARS] + [F.col("save_score")]
    num = sum((F.coalesce(v * 0.2, F.lit(0.0)) for v in parts), F.lit(0.0))
    den = sum((F.when(v.isNotNull(), 0.2).otherwise(0.0) for v in parts), F.lit(0.0))
    return x.withColumn("overall", F.when(den > 0, num / den)).select(*by, *PILLARS, "save_pct", "save_score", "overall", "saves", "goals", "sog", "clips")


def letter(score: Column) -> Column:
    """Letter with plus or minus; A has no plus."""
    r = F.floor(score).cast("int")
    base = F.when(score >= 90, "A").when(score >= 80, "B").when(score >= 70, "C").when(score >= 60, "D").otherwise("F")
    d = r % 10
    sign = F.when(score < 60, "").when((d >= 7) & (score < 90), "+").when((d <= 3) & (r < 100), "-").otherwise("")
    return F.when(score.isNotNull(), F.concat(base, sign))


def report_card(clips: DataFrame, by: Sequence[str] = ("vid", "season")) -> DataFrame:
    x = pillar_scores(game_sums(clips), list(by))
    return x.withColumn("grade", letter(F.col("overall")))


def _recent(sums: DataFrame) -> DataFrame:
    """Mark each game as recent or prior within its season."""
    w = W.partitionBy("vid", "season")
    n = F.count("*").over(w)
    k = F.when(n < 6, F.greatest(F.floor(n / 2), F.lit(1))).otherwise(3)
    return sums.withColumn("__r", F.row_number().over(w.orderBy(F.desc("game")))).withColumn("part", F.when(F.col("__r") <= k, "recent").otherwise("prior"))


def trends(clips: DataFrame, step: float = 4.0) -> DataFrame:
    """Pillar movement: recent games pooled against all earlier ones."""
    x = pillar_scores(_recent(game_sums(clips)), ["vid", "season", "part"])
    pair = F.array(*[F.struct(F.lit(p).alias("pillar"), F.col(p).alias("score")) for p in (*PILLARS, "save_score", "overall")])
    long = x.select("vid", "season", "part", F.explode(pair).alias("p"))
    out = long.groupBy("vid", "season", F.col("p.pillar").alias("pillar")).agg(
        F.max(F.when(F.col("part") == "recent", F.col("p.score"))).alias("recent"), F.max(F.when(F.col("part") == "prior", F.col("p.score"))).alias("prior")
    )
    d = F.col("recent") - F.col("prior")
    word = F.when(d.isNull(), "not_enough").when(d >= step, "improving").when(d <= -step, "declining").otherwise("steady")
    return out.withColumn("delta", d).withColumn("trend", word)


def milestones(clips: DataFrame, min_games: int = 3) -> DataFrame:
    """Season milestones: best month, wall nights, grade streaks, most improved."""
    sums = game_sums(clips)
    per_game = pillar_scores(sums, ["vid", "season", "game"])
    month = sums.groupBy("vid", "season", "month").agg(F.count("*").alias("n"), F.sum("saves").alias("s"), F.sum("goals").alias("g"))
    month = month.filter("n >= 2 and s + g > 0").groupBy("vid", "season").agg(
        F.max_by(F.struct("month", (F.col("s") / (F.col("s") + F.col("g"))).alias("v")), F.struct(F.col("s") / (F.col("s") + F.col("g")), "month")).alias("b")
    )
    best = month.select("vid", "season", F.lit("best_month").alias("type"), F.col("b.month").cast("string").alias("label"), F.col("b.v").alias("value"))
    wall = per_game.filter("goals = 0 and sog >= 15").select("vid", "season", F.lit("wall_night").alias("type"), F.col("game").cast("string").alias("label"), F.col("sog").cast("double").alias("value"))
    w = W.partitionBy("vid", "season").orderBy("game")
    x = per_game.withColumn("__i", F.row_number().over(w)).filter("overall >= 80")
    x = x.withColumn("__k", F.col("__i") - F.row_number().over(w))
    streak = x.groupBy("vid", "season", "__k").agg(F.count("*").alias("n"), F.min("game").alias("a")).filter(F.col("n") >= min_games)
    streak = streak.select("vid", "season", F.lit("streak").alias("type"), F.col("a").cast("string").alias("label"), F.col("n").cast("double").alias("value"))
    t = trends(clips).filter(F.col("pillar").isin(*PILLARS) & (F.col("delta") >= 6))
    better = t.groupBy("vid", "season").agg(F.max_by(F.struct("pillar", "delta"), F.struct("delta", "pillar")).alias("b"))
    better = better.select("vid", "season", F.lit("most_improved").alias("type"), F.col("b.pillar").alias("label"), F.col("b.delta").alias("value"))
    return best.unionByName(wall).unionByName(streak).unionByName(better)


def digest(clips: DataFrame) -> DataFrame:
    """Family digest inputs: early against late half of a season's games."""
    sums = game_sums(clips).withColumn("half", F.ntile(2).over(W.partitionBy("vid", "season").orderBy("game")))
    aggs = {f"{p}_{k}": F.sum(f"{p}_{k}") for p in PILLARS for k in ("ws", "w")}
    h = sums.groupBy("vid", "season", "half").agg(*[v.alias(k) for k, v in aggs.items()], F.sum("saves").alias("saves"), F.sum("sog").alias("sog"), F.count("*").alias("games"))
    pick = lambda half, c: F.max(F.when(F.col("half") == half, c))
    cols = [F.sum("games").alias("games_played"), F.sum("sog").alias("sog")]
    sv = F.when(F.col("sog") > 0, F.col("saves") / F.col("sog"))
    cols += [pick(1, sv).alias("from_pct"), pick(2, sv).alias("to_pct")]
    for p in PILLARS:
        s = F.when(F.col(f"{p}_w") > 0, F.col(f"{p}_ws") / F.col(f"{p}_w"))
        cols += [pick(1, s).alias(f"{p}_early"), pick(2, s).alias(f"{p}_late")]
    x = h.groupBy("vid", "season").agg(*cols)
    deltas = F.array(*[F.struct((F.col(f"{p}_late") - F.col(f"{p}_early")).alias("d"), F.lit(p).alias("p")) for p in PILLARS])
    late = F.array(*[F.struct(F.col(f"{p}_late").alias("d"), F.lit(p).alias("p")) for p in PILLARS])
    top = F.array_max(F.filter(deltas, lambda e: e["d"] > 0))
    low = F.array_min(F.filter(late, lambda e: e["d"].isNotNull()))
    return x.select(
        "vid", "season", "games_played", "from_pct", "to_pct", (F.col("to_pct") - F.col("from_pct")).alias("save_delta"),
        top["p"].alias("most_improved"), low["p"].alias("growth_area"), ((F.col("games_played") < 3) | (F.col("sog") < 15)).alias("small_sample"),
    )


def profile(clips: DataFrame, shots: DataFrame | None = None, by: Sequence[str] = ("vid",), version: str = "1") -> DataFrame:
    """Season stat profile: pooled totals, positioning bands, provenance.

    The danger-weighted save rate needs tiers on every game: it is left out for
    a scope in which any clip's game has no shot with a tier.
    """
    by = list(by)
    three = {"Excellent": 1.0, "Good": 2.0, "Average": 3.0, "Poor": 3.0}
    depth3 = {"Base (B)": 1.0, "Aggressive (A)": 2.0, "Conservative (C)": 3.0, "Defensive (D)": 3.0}
    x = clips.groupBy(*by).agg(
        F.count_distinct("game").alias("games"), F.sum("shots").alias("shots"), F.sum("sog").alias("sog"), F.sum("saves").alias("saves"), F.sum("goals").alias("goals"),
        F.avg(scale("depth_rank", depth3)).alias("depth"), F.avg(scale("cover_angle_rank", three)).alias("angle"), F.avg(scale("squareness_rank", three)).alias("squareness"),
    )
    band = lambda c: F.when(F.col(c) < 1.67, "Elite").when(F.col(c) < 2.34, "Good").when(F.col(c).isNotNull(), "Needs work")
    x = x.withColumn("save_pct", F.when(F.col("sog") > 0, F.col("saves") / F.col("sog")))
    for c in ("depth", "angle", "squareness"):
        x = x.withColumn(f"{c}_band", band(c))
    x = x.withColumn("engine_version", F.lit(version))
    if shots is None:
        return x
    weight = scale("danger", {"high": 3.0, "medium": 2.0, "low": 1.0})
    per_game = shots.filter(F.col("outcome").isin("save", "goal")).groupBy(*by, "game").agg(
        F.sum(F.when(F.col("outcome") == "save", weight).otherwise(0.0)).alias("a"), F.sum(weight).alias("b"), F.bool_and(F.col("danger").isNotNull()).alias("full")
    )
    all_games = clips.select(*by, "game").distinct().join(per_game, [*by, "game"], "left")
    d = all_games.groupBy(*by).agg(F.bool_and(F.coalesce("full", F.lit(False))).alias("__ok"), F.sum("a").alias("a"), F.sum("b").alias("b"))
    return x.join(d.select(*by, F.when(F.col("__ok"), F.col("a") / F.col("b")).alias("danger_save_pct")), by, "left")


def with_game(clips: DataFrame, games: DataFrame) -> DataFrame:
    """Clip rows with the teams and season of their game."""
    return clips.join(games.select("vid", "target_team", "opponent_team", F.col("season").alias("game_season")), "vid", "left")
