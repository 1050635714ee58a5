"""Interval algebra on segments ``(vid, start_s, end_s, ...)``.

Segments are half-open.  Classified segments carry ``threat`` (boolean) and
``color``; ``ord`` is the arrival order used to break ties.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..blocks import BLOCK, carry, cut, merge_spans, point_join, span_join
from ..machines import HOUR, Chain, run_blocks

KEYS = ["vid"]
SEG = "struct<start_s:int,end_s:int,threat:boolean,color:string>"


def as_of(
    left: DataFrame,
    right: DataFrame,
    t_left: str,
    t_right: str,
    out: str,
    forward: bool = False,
    keys: Sequence[str] = KEYS,
    rank: Sequence[Column] = (),
    unique_left: bool = False,
) -> DataFrame:
    """Attach the nearest right row as struct ``out``.

    Backward takes the last right row with ``t <= left t``; forward the first
    with ``t > left t``.  ``rank`` orders right rows sharing a time: the last
    one wins going backward, the first one going forward.  Both sides are
    reduced to distinct times and walked once in time order, so no pairs are
    formed; the answer per time is joined back on ``(keys, time)``.
    """
    keys = list(keys)
    payload = [c for c in right.columns if c not in keys]
    tie = F.struct(*rank) if rank else F.struct(F.lit(0))
    pick = F.min_by if forward else F.max_by
    r = right.groupBy(*keys, F.col(t_right).cast("double").alias("__t")).agg(
        pick(F.struct(*payload), tie).alias("__r")
    ).withColumn("__side", F.lit(0))
    times = left.select(*keys, F.col(t_left).cast("double").alias("__t"), *([F.struct(*left.columns).alias("__l")] if unique_left else []))
    times = (times if unique_left else times.distinct()).withColumn("__side", F.lit(1))
    both = r.unionByName(times, allowMissingColumns=True)
    both = carry(both, keys, "__t", {out: ("last", F.col("__r"))}, order=["__t", "__side"], reverse=forward)
    both = both.filter("__side = 1")
    if unique_left:
        return both.select("__l.*", out)
    found = both.select(*keys, "__t", out)
    return left.withColumn("__t", F.col(t_left).cast("double")).join(found, [*keys, "__t"]).drop("__t")


# -- merging ---------------------------------------------------------------


def expand_merge(peaks: DataFrame, lengths: DataFrame, pre: int, post: int) -> DataFrame:
    """Peaks to clamped windows; overlapping or touching ones merge.

    ``lengths`` holds ``(vid, max_t)``.
    """
    spans = peaks.join(lengths, "vid").select(
        "vid",
        F.greatest(F.col("t") - pre, F.lit(0)).alias("start_s"),
        F.least(F.col("t") + post, F.col("max_t")).alias("end_s"),
    )
    return merge_spans(spans, KEYS, "start_s", "end_s", 0)


def merge_overlap(df: DataFrame, conf: str = "confidence") -> DataFrame:
    """Merge overlapping or touching windows, keeping the top confidence."""
    return merge_spans(df, KEYS, "start_s", "end_s", 0, aggs={conf: ("max", F.col(conf))})


#: actions that make a threat window (fixed values)
THREAT_ACTIONS = ("Shots", "Goals")


def merge_events(
    gt: DataFrame, gap: float = 8, actions: Sequence[str] = THREAT_ACTIONS
) -> DataFrame:
    """Ground-truth rows to windows per team; gaps below ``gap`` are bridged.

    The period of the earliest row is kept.  ``gt_id`` numbers the windows of a
    recording by start, then by the order in which teams first appear.
    """
    rows = gt.filter(F.col("action").isin(*actions))
    first = rows.groupBy("vid", "team").agg(F.min("idx").alias("team_first"))
    merged = merge_spans(
        rows, ["vid", "team"], "start_s", "end_s", gap, inclusive=False,
        aggs={"__p": ("min", F.struct("start_s", "idx", "half"))},
    )
    merged = merged.select("vid", "team", "start_s", "end_s", F.col("__p.half").alias("period"))
    merged = merged.join(first, ["vid", "team"])
    numbered = carry(merged, KEYS, "start_s", {"gt_id": ("sum", F.lit(1))}, ["start_s", "team_first"])
    return numbered.select("vid", F.col("gt_id").cast("int").alias("gt_id"), "start_s", "end_s", "team", "period")


def pad(df: DataFrame, s: float) -> DataFrame:
    """Widen both ends, start clamped at zero."""
    if s <= 0:
        return df
    return df.withColumn("start_s", F.greatest(F.col("start_s") - s, F.lit(0))).withColumn("end_s", F.col("end_s") + s)


def _seg(start, end, threat, color) -> Column:
    return F.struct(
        start.cast("int").alias("start_s"),
        end.cast("int").alias("end_s"),
        threat.alias("threat"),
        color.alias("color"),
    )


def _gap(start, end) -> Column:
    return _seg(start, end, F.lit(False), F.lit(None).cast("string"))


def _fold_segments(groups: DataFrame, step) -> Column:
    """Fold ``__segs`` with state (finished segments, open segment)."""
    init = F.struct(
        F.expr(f"cast(array() as array<{SEG}>)").alias("done"), F.expr(f"cast(null as {SEG})").alias("cur")
    )
    return F.aggregate(F.col("__segs"), init, step, lambda a: F.array_append(a["done"], a["cur"]))


def _state(done: Column, cur: Column) -> Column:
    return F.struct(done.alias("done"), cur.alias("cur"))


def merge_classified(df: DataFrame) -> DataFrame:
    """Resolve overlaps between classified segments and fill gaps.

    Same class: union.  Different class: the later segment cuts the earlier one
    (or replaces it when both start together) and nothing restores the tail.
    Gaps become no-threat segments.  Of the segments with one start only the last
    in order counts, and whether all are of its class, so they are summed up first,
    with map-side combine.  Folding runs inside overlap islands of these sums; a
    segment starting exactly where an island ends begins a new one.  Segments have a
    positive length; ties in (start, end) go by ``ord``.
    """
    df = df.select("vid", F.col("start_s").cast("int").alias("start_s"), F.col("end_s").cast("int").alias("end_s"), "threat", "color", "ord")
    cls = F.struct("threat", F.coalesce("color", F.lit("")), F.col("color").isNull())
    starts = df.groupBy("vid", "start_s").agg(
        F.max_by(F.struct("end_s", "threat", "color"), F.struct("end_s", "ord")).alias("__last"), (F.min(cls) == F.max(cls)).alias("__one")
    ).select("vid", "start_s", "__last.*", "__one")
    groups = merge_spans(
        starts, KEYS, "start_s", "end_s", 0, inclusive=False, distinct=True,
        aggs={"__segs": ("list", F.struct("start_s", "end_s", "threat", "color", F.col("__one").alias("one")))},
    ).select("vid", F.col("start_s").alias("island"), F.array_sort("__segs").alias("__segs"))

    def step(acc, x):
        cur, done = acc["cur"], acc["done"]
        me = _seg(x["start_s"], x["end_s"], x["threat"], x["color"])
        same = x["one"] & (cur["threat"] == x["threat"]) & cur["color"].eqNullSafe(x["color"])
        cut = _seg(cur["start_s"], x["start_s"], cur["threat"], cur["color"])
        joined = _seg(cur["start_s"], F.greatest(cur["end_s"], x["end_s"]), cur["threat"], cur["color"])
        return (
            F.when(cur.isNull(), _state(done, me))
            .when(
                x["start_s"] > cur["end_s"],
                _state(F.concat(done, F.array(cur, _gap(cur["end_s"], x["start_s"]))), me),
            )
            .when(x["start_s"] == cur["end_s"], _state(F.array_append(done, cur), me))
            .when(same, _state(done, joined))
            .otherwise(_state(F.array_append(done, cut), me))
        )

    folded = groups.select("vid", "island", _fold_segments(groups, step).alias("segs"))
    folded = folded.withColumn("__end", F.element_at("segs", -1)["end_s"])
    # islands are far apart, so the gap before each is filled from one lookup
    folded = carry(folded, KEYS, "island", {"__prev": ("last", F.col("__end"))})
    with_gap = F.when(
        F.col("__prev") < F.col("island"), F.concat(F.array(_gap(F.col("__prev"), F.col("island"))), F.col("segs"))
    ).otherwise(F.col("segs"))
    return folded.select("vid", F.explode(with_gap).alias("s")).select("vid", "s.*")


def cover(df: DataFrame, lengths: DataFrame, block: int | None = None) -> DataFrame:
    """Clamp to ``[0, dur]`` and fill leading, inner and trailing gaps.

    ``lengths`` holds ``(vid, dur)``; a recording without segments becomes one
    no-threat segment.  Give ``block`` for raw rows: they are then ordered per
    block of time instead of per recording.
    """
    x = df.join(lengths, "vid")
    clamp = lambda c: F.greatest(F.least(F.col(c), F.col("dur")), F.lit(0)).cast("int")
    kept = x.withColumn("__raw", F.col("start_s")).withColumn("start_s", clamp("start_s")).withColumn("end_s", clamp("end_s"))
    kept = kept.filter("end_s > start_s")
    if "ord" not in kept.columns:
        kept = kept.withColumn("ord", F.lit(0))
    kept = carry(kept, KEYS, "__raw", {"__prev": ("last", F.col("end_s"))}, ["__raw", "ord"], block)
    me = _seg(F.col("start_s"), F.col("end_s"), F.col("threat"), F.col("color"))
    body = kept.select(
        "vid",
        F.explode(
            F.when(F.col("__prev") < F.col("start_s"), F.array(_gap(F.col("__prev"), F.col("start_s")), me)).otherwise(F.array(me))
        ).alias("s"),
    ).select("vid", "s.*")
    lead = x.groupBy("vid").agg(F.min("start_s").alias("a"), F.max("dur").alias("dur"))
    ends = kept.groupBy("vid").agg(F.min("start_s").alias("first"), F.max_by("end_s", F.struct("__raw", "ord")).alias("last"))
    edges = lengths.join(lead.drop("dur"), "vid", "left").join(ends, "vid", "left")
    none = F.expr(f"cast(array() as array<{SEG}>)")
    front = (
        F.when(F.col("a").isNull(), F.array(_gap(F.lit(0), F.col("dur"))))
        .when((F.col("a") > 0) & F.col("first").isNull(), F.array(_gap(F.lit(0), F.col("dur"))))
        .when(
            (F.col("a") > 0) & (F.col("a") < F.col("first")),
            F.array(_gap(F.lit(0), F.col("a")), _gap(F.col("a"), F.col("first"))),
        )
        .when(F.col("a") > 0, F.array(_gap(F.lit(0), F.col("a"))))
        .otherwise(none)
    )
    back = F.when(F.col("last") < F.col("dur"), F.array(_gap(F.col("last"), F.col("dur")))).otherwise(none)
    rest = edges.select("vid", F.explode(F.concat(front, back)).alias("s")).select("vid", "s.*")
    return body.unionByName(rest)


def merge_adjacent(df: DataFrame, cap: int = 60, block: int = HOUR) -> DataFrame:
    """Merge neighbours of one class; a threat may not grow beyond ``cap``.

    The cap is compared with the span of the merged segment.  Runs of one class are
    found by a running aggregate per block; runs that stay within the cap are one
    segment.  In the others each merged segment begins at the first one that would
    have passed the cap of the one before: a chain of heads, run block by block.
    """
    order = ["start_s", "end_s", "threat", "color"]
    x = df.select("vid", "start_s", "end_s", "threat", "color")
    x = carry(x, KEYS, "start_s", {"__prev": ("last", F.struct("threat", "color"))}, order, block)
    opens = F.col("__prev").isNull() | ~((F.col("__prev.threat") == F.col("threat")) & F.col("__prev.color").eqNullSafe(F.col("color")))
    me = F.struct(*order)
    x = x.withColumn("__head", F.when(opens, me)).drop("__prev")
    x = cut(carry(x, KEYS, "start_s", {"__run": ("last", F.col("__head"))}, order, block).select("vid", *order, F.coalesce("__head", "__run").alias("run")))
    runs = x.groupBy("vid", "run").agg(F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"))
    long = F.col("run.threat") & (F.col("end_s") - F.col("start_s") > cap)
    whole = runs.filter(~long).select("vid", "start_s", "end_s", "run.threat", "run.color")
    rest = x.join(runs.filter(long).select("vid", "run"), ["vid", "run"], "left_semi")
    rest = rest.select("vid", F.to_json("run").alias("key"), F.col("start_s").alias("a"), F.col("end_s").alias("b"), F.col("start_s").alias("base"))
    chain = Chain(cap, strict=True, out="a int, b int, base int, head_block bigint, head_no bigint, is_head boolean")
    parts = run_blocks(rest, ["vid", "key"], "a", ["a", "b", "base"], chain, block)[0]
    capped = parts.groupBy("vid", "key", "head_block", "head_no").agg(F.min("a").alias("start_s"), F.max("b").alias("end_s"))
    kind = F.from_json("key", "threat boolean, color string")
    return whole.unionByName(capped.select("vid", "start_s", "end_s", kind["threat"].alias("threat"), kind["color"].alias("color")))


# -- splitting -------------------------------------------------------------


def split_long(df: DataFrame, limit: int = 60) -> DataFrame:
    """Cut threats longer than ``limit`` into chunks of at most ``limit``."""
    long = F.col("threat") & (F.col("end_s") - F.col("start_s") > limit)
    starts = F.when(long, F.sequence(F.col("start_s"), F.col("end_s") - 1, F.lit(limit))).otherwise(F.array("start_s"))
    return (
        df.withColumn("__end", F.col("end_s"))
        .withColumn("__long", long)
        .withColumn("start_s", F.explode(starts))
        .withColumn("end_s", F.when(F.col("__long"), F.least(F.col("start_s") + limit, F.col("__end"))).otherwise(F.col("__end")))
        .drop("__end", "__long")
    )


def split_periods(df: DataFrame, periods: DataFrame, block: int = BLOCK) -> DataFrame:
    """Cut at period edges and drop time outside; no valid period: unchanged.

    ``periods`` holds ``(vid, p_start, p_end)``.
    """
    valid = periods.select("vid", "p_start", "p_end").filter("p_start is not null and p_end is not null and p_end > p_start")
    has = valid.select("vid").distinct()
    inside = (
        span_join(df.filter("end_s > start_s"), valid, KEYS, ("start_s", "end_s"), ("p_start", "p_end"), block)
        .filter("end_s > p_start and start_s < p_end")
        .withColumn("__s", F.greatest("start_s", "p_start"))
        .withColumn("end_s", F.least("end_s", "p_end"))
        .withColumn("start_s", F.col("__s"))
        .select(*df.columns)
    )
    return inside.unionByName(df.join(has, "vid", "left_anti"))


def cap_split(
    df: DataFrame, max_len: int = 90, overlap: int = 15, ratio: float = 1.10, min_len: int = 100, ratio_col: str = "motion_ratio"
) -> DataFrame:
    """Overlapping chunks for long threats whose motion ratio is low."""
    if max_len <= overlap:
        raise ValueError("max_len must exceed overlap")
    stride = max_len - overlap
    dur = F.col("end_s") - F.col("start_s")
    split = F.col("threat") & (dur > min_len) & (F.coalesce(F.col(ratio_col), F.lit(1.0)) < ratio)
    last = F.greatest(F.ceil((dur - max_len) / F.lit(stride)), F.lit(0)).cast("int")
    none = F.lit(None)
    return (
        df.withColumn("__split", split)
        .withColumn("__p", F.concat_ws("-", F.col("start_s").cast("string"), F.col("end_s").cast("string")))
        .withColumn("__k", F.explode(F.when(split, F.sequence(F.lit(0), last)).otherwise(F.array(F.lit(0)))))
        .withColumn("__e", F.col("end_s"))
        .withColumn("start_s", F.col("start_s") + F.col("__k") * stride)
        .withColumn("end_s", F.when(F.col("__split"), F.least(F.col("start_s") + max_len, F.col("__e"))).otherwise(F.col("__e")))
        .withColumn("capped_parent", F.when(F.col("__split"), F.col("__p")).otherwise(none))
        .withColumn("capped_index", F.when(F.col("__split"), F.col("__k")).otherwise(none))
        .drop("__split", "__p", "__k", "__e")
    )


# -- filters against other signals -----------------------------------------


def confirm(
    win: DataFrame,
    events: DataFrame | None,
    min_overlap: int = 8,
    event_width: int = 8,
    source: str = "motion_auto_close",
    block: int = BLOCK,
) -> DataFrame:
    """Drop ``source`` windows that nothing else overlaps by ``min_overlap``.

    Confirming spans are windows of any other source and ``events`` (times
    widened to ``event_width``).  Per start only the longest span matters.
    """
    width = max(min_overlap, event_width)
    other = win.filter(F.col("source") != source).select("vid", "start_s", "end_s")
    if events is not None:
        other = other.unionByName(
            events.select("vid", F.floor("t").cast("int").alias("start_s"), (F.floor("t") + width).cast("int").alias("end_s"))
        )
    other = other.groupBy("vid", F.col("start_s").alias("o_start")).agg(F.max("end_s").alias("o_end"))
    mac = win.filter(F.col("source") == source)
    ok = (
        span_join(mac.select("vid", "start_s", "end_s").distinct(), other, KEYS, ("start_s", "end_s"), ("o_start", "o_end"), block)
        .filter(F.least("end_s", "o_end") - F.greatest("start_s", "o_start") >= min_overlap)
        .select("vid", "start_s", "end_s")
        .distinct()
    )
    return win.filter(F.col("source") != source).unionByName(mac.join(ok, ["vid", "start_s", "end_s"], "left_semi"))


def trim_at_event(win: DataFrame, events: DataFrame, grace: int = 12) -> DataFrame:
    """End a window ``grace`` after the earliest event strictly inside it."""
    ev = events.select("vid", F.col("t").alias("ev_t")).distinct()
    x = as_of(win, ev, "start_s", "ev_t", "__ev", forward=True)
    t = F.col("__ev.ev_t")
    cut = F.least(F.col("end_s"), (F.floor(t) + grace).cast("int"))
    return x.withColumn("end_s", F.when(t < F.col("end_s"), cut).otherwise(F.col("end_s"))).drop("__ev")


def min_duration(df: DataFrame, s: int = 15, inclusive: bool = False) -> DataFrame:
    """Keep spans lasting ``s``; ``inclusive`` counts the end second (runs)."""
    length = F.col("end_s") - F.col("start_s") + (1 if inclusive else 0)
    return df.filter(length >= s)


def drop_opening_fp(win: DataFrame, triggers: DataFrame, until: int = 20) -> DataFrame:
    """Drop windows ending by ``until`` that hold no hard trigger (closed).

    Only triggers in the opening seconds can matter, so at most ``until + 1``
    distinct trigger seconds per recording are compared.
    """
    t = triggers.filter(F.col("t") <= until).groupBy("vid").agg(F.collect_set("t").alias("__ts"))
    early = win.filter(F.col("end_s") <= until).join(t, "vid", "left")
    s, e = F.col("start_s"), F.col("end_s")
    kept = early.filter(F.exists(F.coalesce("__ts", F.expr("cast(array() as array<int>)")), lambda x: (x >= s) & (x <= e)))
    return win.filter(F.col("end_s") > until).unionByName(kept.drop("__ts"))


def demote_short(df: DataFrame, s: int = 5) -> DataFrame:
    """Threats shorter than ``s`` become no-threat segments."""
    short = F.col("threat") & (F.col("end_s") - F.col("start_s") < s)
    return df.withColumn("color", F.when(~short, F.col("color"))).withColumn("threat", F.col("threat") & ~short)


def threat_windows(df: DataFrame) -> DataFrame:
    return df.filter("threat").select("vid", "start_s", "end_s", "color")


def target_filter(seg: DataFrame, games: DataFrame) -> DataFrame:
    """Threats on the target's colour."""
    g = games.select("vid", "target_color")
    return seg.join(g, "vid").filter(F.col("threat") & (F.col("color") == F.col("target_color"))).drop("target_color")


def target_filter_counts(seg: DataFrame, games: DataFrame) -> DataFrame:
    """Segment counts before and after the target filter, per recording."""
    x = seg.join(games.select("vid", "target_color"), "vid")
    is_target = F.col("threat") & F.coalesce(F.col("color") == F.col("target_color"), F.lit(False))
    return (
        x.groupBy("vid")
        .agg(F.count("*").alias("total"), F.count_if("threat").alias("threats"), F.count_if(is_target).alias("target"))
        .select("vid", "total", "threats", "target", (F.col("threats") - F.col("target")).alias("opponent"),
                (F.col("total") - F.col("threats")).alias("no_threat"))
    )


def hybrid(primary: DataFrame, fallback: DataFrame, n: int = 30) -> DataFrame:
    """Use a recording's fallback windows when the primary has fewer than ``n``."""
    rich = primary.groupBy("vid").count().filter(F.col("count") >= n).select("vid")
    return primary.join(rich, "vid", "left_semi").withColumn("method", F.lit("primary")).unionByName(
        fallback.join(rich, "vid", "left_anti").withColumn("method", F.lit("fallback"))
    )


def gate_windows(win: DataFrame, series: DataFrame, thr: float, block: int = BLOCK) -> DataFrame:
    """Peak of the series in each closed window and whether to skip it.

    No series at all means peak 1.0; a window beyond the series has peak 0.0.
    Distinct windows are looked up once.
    """
    spans = win.select("vid", "start_s", "end_s").distinct()
    peaks = (
        point_join(spans, series.select("vid", "t", "p"), KEYS, ("start_s", "end_s"), "t", block)
        .groupBy("vid", "start_s", "end_s")
        .agg(F.max("p").alias("__peak"))
    )
    known = series.select("vid").distinct().withColumn("__has", F.lit(True))
    out = win.join(peaks, ["vid", "start_s", "end_s"], "left").join(known, "vid", "left")
    out = out.withColumn(
        "peak", F.when(F.col("__has").isNull(), F.lit(1.0)).otherwise(F.coalesce("__peak", F.lit(0.0)))
    ).drop("__peak", "__has")
    return out.withColumn("skip", (F.col("peak") < thr) if thr > 0 else F.lit(False))


# -- summaries -------------------------------------------------------------


def threat_seconds(df: DataFrame) -> DataFrame:
    """Whole seconds under threat; broken bounds are skipped."""
    ok = F.coalesce(F.col("threat"), F.lit(True)) & (F.col("end_s") > F.col("start_s"))
    return df.filter(ok).groupBy("vid").agg(
        F.bround(F.sum((F.col("end_s") - F.col("start_s")).cast("double")), 0).cast("long").alias("threat_seconds")
    )


def source_trace(final: DataFrame, raw: DataFrame, block: int = BLOCK) -> DataFrame:
    """Sources and number of raw windows overlapping each final threat."""
    r = raw.groupBy("vid", F.col("start_s").alias("r_start"), F.col("end_s").alias("r_end"), "source").agg(
        F.count("*").alias("__n")
    )
    spans = final.select("vid", "start_s", "end_s").distinct()
    hits = (
        span_join(spans, r, KEYS, ("start_s", "end_s"), ("r_start", "r_end"), block)
        .filter("r_end > start_s and r_start < end_s")
        .groupBy("vid", "start_s", "end_s")
        .agg(F.array_sort(F.collect_set("source")).alias("source_signals"), F.sum("__n").alias("n_overlapping_raw"))
    )
    return (
        final.join(hits, ["vid", "start_s", "end_s"], "left")
        .withColumn("source_signals", F.coalesce("source_signals", F.expr("cast(array() as array<string>)")))
        .withColumn("n_overlapping_raw", F.coalesce("n_overlapping_raw", F.lit(0)))
    )
