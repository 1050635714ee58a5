"""Operators on per-second series ``(vid, t, value)``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..blocks import BLOCK, carry, islands, merge_spans, own_rows, with_halo
from ..functions.timefmt import fmt_mmss
from ..machines import HOUR, Chain, TwoThresholds, run_blocks

KEYS = ("vid",)


# -- shape -----------------------------------------------------------------


def dedupe_last(df: DataFrame, keys: Sequence[str], t: str, value: str, order: str) -> DataFrame:
    """One value per second: the row loaded last wins."""
    return df.groupBy(*keys, t).agg(F.max_by(value, order).alias(value))


def spine(length: DataFrame, keys: Sequence[str], n: str, t: str = "t", block: int = BLOCK) -> DataFrame:
    """Seconds ``0 .. n-1``, generated block by block so long timelines spread."""
    starts = length.filter(F.col(n) > 0).withColumn(
        "__b", F.explode(F.expr(f"sequence(0L, cast(({n} - 1) div {block} as bigint))"))
    )
    upto = F.least(F.col("__b") * block + block - 1, F.col(n) - 1)
    secs = F.transform(F.sequence(F.col("__b") * block, upto), lambda x: x.cast("int"))
    return starts.withColumn(t, F.explode(secs)).drop("__b")


def densify(
    df: DataFrame, value: str = "p", by: Sequence[str] = KEYS, t: str = "t", order: str | None = None
) -> DataFrame:
    """Every second from 0 to the last one seen; missing seconds are 0.0."""
    if order:
        df = dedupe_last(df, by, t, value, order)
    length = df.groupBy(*by).agg((F.max(t) + 1).alias("__n"))
    grid = spine(length, by, "__n", t).drop("__n")
    return grid.join(df.select(*by, t, value), [*by, t], "left").withColumn(
        value, F.coalesce(value, F.lit(0.0))
    )


def duration(df: DataFrame, fallback: DataFrame | None = None, default: int = 7200) -> DataFrame:
    """Last second per recording; ids only in ``fallback`` get ``default``."""
    got = df.groupBy("vid").agg(F.max("t").alias("duration"))
    if fallback is None:
        return got
    return (
        fallback.select("vid")
        .distinct()
        .join(got, "vid", "left")
        .withColumn("duration", F.coalesce("duration", F.lit(default)))
    )


# -- fusion, smoothing, peaks ----------------------------------------------


def fuse(df: DataFrame, weights: dict[str, float], block: int = BLOCK) -> DataFrame:
    """Weighted sum of channels cut to the shortest one.

    Weights are renormalised over the channels a recording has.
    """
    df = df.filter(F.col("channel").isin(*weights))
    per_channel = df.groupBy("vid", "channel").agg((F.max("t") + 1).alias("n"))
    w = F.coalesce(*[F.when(F.col("channel") == c, F.lit(float(x))) for c, x in weights.items()])
    length = per_channel.groupBy("vid").agg(F.min("n").alias("__n"), F.sum(w).alias("__w"))
    pivot = df.groupBy("vid", "t").agg(
        *[F.max(F.when(F.col("channel") == c, F.col("p"))).alias(f"__p{i}") for i, c in enumerate(weights)]
    )
    terms = [
        F.lit(float(x)) / F.col("__w") * F.coalesce(F.col(f"__p{i}"), F.lit(0.0))
        for i, x in enumerate(weights.values())
    ]
    total = terms[0]
    for term in terms[1:]:
        total = total + term
    return spine(length, KEYS, "__n", block=block).join(pivot, ["vid", "t"], "left").select(
        "vid", "t", total.alias("p")
    )


def _block_window(keys: Sequence[str]):
    return W.partitionBy(*keys, "__blk").orderBy("t")


def _smooth(df: DataFrame, k: int, keys: Sequence[str], value: str = "p") -> DataFrame:
    w = _block_window(keys)
    half = k // 2
    first = F.first(value).over(w.rowsBetween(W.unboundedPreceding, 0))
    last = F.last(value).over(w.rowsBetween(0, W.unboundedFollowing))
    parts: list[Column] = [F.coalesce(F.lag(value, i).over(w), first) for i in range(half, 0, -1)]
    parts.append(F.col(value))
    parts += [F.coalesce(F.lead(value, i).over(w), last) for i in range(1, half + 1)]
    total = parts[0]
    for part in parts[1:]:
        total = total + part
    return df.withColumn(value, total / k)


def smooth(df: DataFrame, k: int = 3, keys: Sequence[str] = KEYS, block: int = BLOCK) -> DataFrame:
    """Centred moving average of a dense series, edges repeated; ``k`` is odd."""
    if k % 2 == 0:
        raise ValueError("k must be odd")
    if k <= 1:
        return df
    return own_rows(_smooth(with_halo(df, "t", k // 2, block), k, keys))


def _maxima(df: DataFrame, thr: float, keys: Sequence[str]) -> DataFrame:
    w = _block_window(keys)
    left = F.coalesce(F.lag("p").over(w), F.lit(-1.0))
    right = F.coalesce(F.lead("p").over(w), F.lit(-1.0))
    return df.withColumn("__l", left).withColumn("__r", right).filter(
        (F.col("p") >= thr) & (F.col("p") >= F.col("__l")) & (F.col("p") > F.col("__r"))
    ).drop("__l", "__r")


def local_maxima(df: DataFrame, thr: float = 0.5, keys: Sequence[str] = KEYS, block: int = BLOCK) -> DataFrame:
    """Seconds at or above ``thr`` not below the left and above the right one."""
    return own_rows(_maxima(with_halo(df, "t", 1, block), thr, keys))


def _drop_beaten(df: DataFrame, d: int, keys: Sequence[str]) -> DataFrame:
    """Drop peaks next to a peak that is the best of its own neighbourhood.

    The best peak within ``d`` on both sides always survives, so whatever lies
    within ``d`` of it never does; dropping those leaves the result unchanged
    and cuts long chains into short ones.
    """
    near = _block_window(keys).rangeBetween(-d, d)
    me = F.struct("p", "t")
    df = df.withColumn("__top", (F.max(me).over(near) == me).cast("int"))
    df = df.withColumn("__beaten", (F.max("__top").over(near) == 1) & (F.col("__top") == 0))
    return df.filter(~F.col("__beaten")).drop("__top", "__beaten")


def _suppress(peaks: DataFrame, d: int, keys: Sequence[str]) -> DataFrame:
    """Greedy suppression inside chains of peaks no further apart than ``d``."""
    chains = merge_spans(
        peaks.withColumn("__t2", F.col("t")), keys, "t", "__t2", d,
        aggs={"__peaks": ("list", F.struct("p", "t"))}, distinct=True,
    )
    kept = F.aggregate(
        F.reverse(F.array_sort("__peaks")),
        F.expr("cast(array() as array<struct<p:double,t:int>>)"),
        lambda acc, x: F.when(
            F.exists(acc, lambda k: F.abs(k["t"] - x["t"]) <= d), acc
        ).otherwise(F.array_append(acc, x)),
    )
    return (
        chains.select(*keys, F.explode(kept).alias("__k"))
        .select(*keys, F.col("__k.t").alias("t"), F.col("__k.p").alias("p"))
    )


def nms(df: DataFrame, d: int = 3, keys: Sequence[str] = KEYS, block: int = BLOCK) -> DataFrame:
    """Keep the highest peaks, none within ``d`` of a higher kept one.

    Ties go to the later second.
    """
    df = df.select(*keys, F.col("t").cast("int").alias("t"), F.col("p").cast("double").alias("p"))
    pruned = own_rows(_drop_beaten(with_halo(df, "t", 2 * d, block), d, keys))
    return _suppress(pruned, d, keys)


def find_peaks(
    df: DataFrame, k: int, thr: float, d: int, keys: Sequence[str] = KEYS, block: int = BLOCK
) -> DataFrame:
    """Smooth, pick maxima and prune in one pass over the blocks, then suppress."""
    halo = k // 2 + 1 + 2 * d
    x = with_halo(df, "t", halo, block)
    x = _smooth(x, k, keys) if k > 1 else x
    x = own_rows(_drop_beaten(_maxima(x, thr, keys), d, keys))
    return _suppress(x, d, keys)


def candidates(
    series: DataFrame,
    weights: dict[str, float],
    thr: float = 0.40,
    d: int = 8,
    k: int = 3,
    cap: int | None = None,
    block: int = BLOCK,
) -> DataFrame:
    """Ranked candidate list per recording from raw channels."""
    peaks = find_peaks(fuse(series, weights, block), k, thr, d, block=block)
    return rank_peaks(peaks, cap)


def rank_peaks(peaks: DataFrame, cap: int | None = None) -> DataFrame:
    order = W.partitionBy("vid").orderBy(F.desc("p"), F.asc("t"))
    ranked = peaks.withColumn("rank", F.row_number().over(order))
    if cap is not None:
        ranked = ranked.filter(F.col("rank") <= cap)
    return ranked.select(
        "vid",
        "rank",
        F.bround(F.col("t").cast("double"), 1).alias("t_seconds"),
        fmt_mmss(F.col("t")).alias("t_mmss"),
        F.bround("p", 4).alias("confidence"),
    )


# -- runs ------------------------------------------------------------------


def number_runs(
    df: DataFrame,
    keys: Sequence[str],
    t: str,
    opens: Column,
) -> DataFrame:
    """Label each row with the start of its run; ``opens`` marks run starts.

    Expects one row per ``t``, so a recording is bounded by its length.
    """
    upto = W.partitionBy(*keys).orderBy(t).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn("run", F.max(F.when(opens, F.col(t))).over(upto))


def runs_strict(df: DataFrame, thr: float = 0.5, max_gap: int = 2, block: int = BLOCK) -> DataFrame:
    """Runs at or above ``thr``; any lower second closes a run.

    Seconds without a row are bridged while hot seconds stay within ``max_gap``.
    """
    w = _block_window(KEYS)
    x = with_halo(df, "t", max_gap, block).withColumn(
        "__joins", F.coalesce((F.col("t") - F.lag("t").over(w) <= max_gap) & (F.lag("p").over(w) >= thr), F.lit(False))
    )
    hot = own_rows(x).filter(F.col("p") >= thr)
    runs = number_runs(hot, KEYS, "t", ~F.col("__joins"))
    return runs.groupBy("vid", F.col("run").alias("start_s")).agg(F.max("t").alias("end_s"))


def runs_bridged(df: DataFrame, thr: float = 0.5, gap: int = 2) -> DataFrame:
    """Runs of hot seconds no more than ``gap`` apart, with the mean score."""
    hot = df.filter(F.col("p") >= thr).withColumn("__t2", F.col("t"))
    pts = islands(
        hot, KEYS, "t", "__t2", gap, aggs={"__s": ("sum", F.col("p")), "__n": ("sum", F.lit(1))}
    )
    return (
        pts.groupBy("vid", F.col("island").alias("start_s"))
        .agg(F.max("t").alias("end_s"), (F.sum("__s") / F.sum("__n")).alias("mean_conf"))
    )


def zscore(df: DataFrame, col: str, out: str = "z", eps: float = 1e-8) -> DataFrame:
    """Standard score over the whole recording (population deviation)."""
    stats = df.groupBy("vid").agg(F.avg(col).alias("__mu"), (F.stddev_pop(col) + eps).alias("__sd"))
    return df.join(stats, "vid").withColumn(out, (F.col(col) - F.col("__mu")) / F.col("__sd")).drop("__mu", "__sd")


def bursts(
    df: DataFrame, thr: float, min_dur: float, hop: float = 1.0, z: str = "z"
) -> DataFrame:
    """Sustained bursts ``z > thr`` of a dense hop series, with their midpoint.

    ``t`` counts hops; a burst ends at the first quiet hop or the series end.
    """
    hot = df.filter(F.col(z) > thr).withColumn("__t2", F.col("t"))
    runs = islands(hot, KEYS, "t", "__t2", 1, distinct=True).groupBy("vid", "island").agg(F.max("t").alias("__last"))
    start = F.col("island") * F.lit(hop)
    end = (F.col("__last") + 1) * F.lit(hop)
    return (
        runs.select("vid", start.alias("start_t"), end.alias("end_t"))
        .filter(F.col("end_t") - F.col("start_t") >= min_dur)
        .withColumn("mid", F.col("start_t") + (F.col("end_t") - F.col("start_t")) / 2)
    )


def refractory(df: DataFrame, r: float, t: str = "mid", block: int = HOUR) -> DataFrame:
    """Accept an event iff it comes ``r`` or more after the last accepted one."""
    pts = df.select("vid", F.col(t).cast("double").alias("t")).distinct().withColumn("base", F.col("t"))
    chain = Chain(r, strict=False, out="t double, base double, head_block bigint, head_no bigint, is_head boolean")
    return run_blocks(pts, KEYS, "t", ["t", "base"], chain, block)[0].filter("is_head").select("vid", "t")


def hysteresis(
    df: DataFrame,
    col: str = "motion",
    open_at: float = 3.0,
    stop_at: float = 1.2,
    min_run: int = 8,
    max_open: int = 30,
    block: int = HOUR,
) -> DataFrame:
    """Open/close windows with two thresholds.

    A window opens after ``min_run`` active seconds (from the run start), closes
    below ``stop_at``, is closed by force after ``max_open`` seconds (which also
    resets the run) and at the end of the recording.  Blocks of seconds are
    worked on in parallel (``machines``), also within one active stretch.
    """
    x = df.select("vid", F.col("t").cast("int").alias("t"), F.col(col).cast("double").alias("m"))
    wins, last = run_blocks(x, KEYS, "t", ["t", "m"], TwoThresholds(open_at, stop_at, min_run, max_open, block), block)
    ends = x.groupBy("vid").agg((F.max("t") + 1).alias("end_s"))
    eof = last.filter(F.get("__exit", F.lit(0)) == 0).join(ends, "vid")
    return wins.unionByName(eof.select("vid", F.get("__exit", F.lit(1)).cast("int").alias("start_s"), "end_s", F.lit("motion_eof").alias("source")))


def side_runs(
    df: DataFrame,
    n: int = 5,
    pre: int = 20,
    post: int = 15,
    score: str = "celeb",
    side: str = "celeb_side",
) -> DataFrame:
    """A window for every ``n`` consecutive rows that favour the same side."""
    key = F.when((F.col(score) > 0) & (F.col(side) != "none"), F.col(side)).otherwise(F.lit(""))
    x = df.select("vid", "t", key.alias("__side"))
    x = carry(x, KEYS, "t", {"__prev": ("last", F.col("__side")), "__i": ("sum", F.lit(1))})
    ends = df.groupBy("vid").agg((F.max("t") + 1).alias("__dur"))
    x = x.filter("__side <> ''")
    opens = F.coalesce(F.col("__prev") != F.col("__side"), F.lit(True))
    x = number_runs(x, KEYS, "__i", opens)
    first = F.col("run")
    chunks = (
        x.groupBy("vid", "run", F.floor((F.col("__i") - first) / n).alias("__chunk"))
        .agg(F.min("t").alias("a"), F.max("t").alias("b"), F.count("*").alias("c"), F.first("__side").alias("celeb_side"))
        .filter(F.col("c") == n)
    )
    return chunks.join(ends, "vid").select(
        "vid",
        F.greatest(F.col("a") - pre, F.lit(0)).alias("start_s"),
        F.least(F.col("b") + post, F.col("__dur")).alias("end_s"),
        "celeb_side",
    )


def trigger_windows(df: DataFrame, col: str, thr: float, pre: int, post: int, source: str) -> DataFrame:
    """A clamped window around every second at or above ``thr``."""
    ends = df.groupBy("vid").agg((F.max("t") + 1).alias("__dur"))
    return (
        df.filter(F.col(col) >= thr)
        .join(ends, "vid")
        .select(
            "vid",
            "t",
            F.greatest(F.col("t") - pre, F.lit(0)).alias("start_s"),
            F.least(F.col("t") + post, F.col("__dur")).alias("end_s"),
            F.lit(source).alias("source"),
        )
    )


# -- training sequences ----------------------------------------------------


def _starts_covering(lo: Column, hi: Column, length: int, stride: int) -> Column:
    """Sequence starts ``lo + i*stride`` that cover ``t`` and fit below ``hi``."""
    first = F.greatest(F.ceil((F.col("t") - length + 1 - lo) / F.lit(stride)), F.lit(0))
    last = F.floor((F.least(F.col("t"), hi - length) - lo) / F.lit(stride))
    return F.when(last >= first, F.transform(F.sequence(first, last), lambda i: (lo + i * stride).cast("int")))


def sequences(
    df: DataFrame, length: int = 32, stride: int = 4, lo: float = 0.0, hi: float = 1.0, value: str = "p"
) -> DataFrame:
    """Fixed-length slices of a dense series inside a fractional time range.

    Each second is sent to the slices covering it, so a slice is one small
    group and no recording is gathered.
    """
    n = df.groupBy("vid").agg((F.max("t") + 1).alias("__n"))
    lo_c = F.expr(f"cast(floor({lo}D * __n) as int)")
    hi_c = F.expr(f"cast(floor({hi}D * __n) as int)")
    x = df.join(n, "vid").filter((F.col("t") >= lo_c) & (F.col("t") < hi_c))
    x = x.withColumn("seq_start", F.explode(_starts_covering(lo_c, hi_c, length, stride)))
    return x.groupBy("vid", "seq_start").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("t", value))), lambda s: s[value]).alias("seq")
    )


def covering_starts(df: DataFrame, length: int = 32, stride: int = 4) -> DataFrame:
    """``(vid, seq_start, t)`` for inference: the last slice ends at the end."""
    n = df.groupBy("vid").agg(F.greatest(F.max("t") + 1, F.lit(length)).alias("__n"))
    x = df.join(n, "vid")
    regular = _starts_covering(F.lit(0), F.col("__n"), length, stride)
    tail = F.col("__n") - length
    extra = F.when((tail % stride != 0) & (F.col("t") >= tail), F.array(tail.cast("int")))
    both = F.concat(
        F.coalesce(regular, F.expr("cast(array() as array<int>)")), F.coalesce(extra, F.expr("cast(array() as array<int>)"))
    )
    return x.withColumn("seq_start", F.explode(both)).drop("__n")


def overlap_average(preds: DataFrame, value: str = "pred") -> DataFrame:
    """Mean of all slice predictions covering a second."""
    return preds.groupBy("vid", "t").agg(F.avg(value).alias("p"))


def score_sequences(df: DataFrame, fn, schema: str) -> DataFrame:
    """Hook for a caller's model: ``fn`` maps Arrow-backed pandas batches."""
    return df.mapInPandas(fn, schema)


def derive_labels(spans: DataFrame, length: DataFrame, pad: int = 1, n: str = "n") -> DataFrame:
    """0/1 grid of seconds touched by a padded span (end second included)."""
    hot = (
        spans.join(length, "vid")
        .select(
            "vid",
            F.explode_outer(
                F.when(
                    F.least(F.col(n), F.col("end_s").cast("int") + pad + 1) > F.greatest(F.lit(0), F.col("start_s").cast("int") - pad),
                    F.sequence(
                        F.greatest(F.lit(0), F.col("start_s").cast("int") - pad),
                        F.least(F.col(n), F.col("end_s").cast("int") + pad + 1) - 1,
                    ),
                )
            ).alias("t"),
        )
        .filter("t is not null")
        .select("vid", F.col("t").cast("int").alias("t"))
        .distinct()
        .withColumn("__hit", F.lit(1))
    )
    return (
        spine(length, KEYS, n)
        .drop(n)
        .join(hot, ["vid", "t"], "left")
        .select("vid", "t", F.coalesce("__hit", F.lit(0)).alias("label"))
    )


def class_weight(labels: DataFrame) -> DataFrame:
    """Positive class weight ``max(1, negatives / max(1, positives))``."""
    g = labels.agg(F.count("*").alias("n"), F.sum("label").alias("pos"))
    return g.select(
        "n", "pos", F.greatest(F.lit(1.0), (F.col("n") - F.col("pos")) / F.greatest(F.lit(1), F.col("pos"))).alias("pos_weight")
    )


def rollup_frames(df: DataFrame, fps: float, frame: str = "frame", n_mfcc: int = 0) -> DataFrame:
    """Audio frame features rolled up to seconds.

    Second ``t`` owns the frames from ``round(t*fps)`` up to ``round((t+1)*fps)``
    with halves rounded to even; a frame therefore sits in its own second or a
    direct neighbour.
    """
    guess = F.floor(F.col(frame) / F.lit(float(fps)))
    edge = lambda s: F.bround(s * F.lit(float(fps)), 0)
    t = (
        F.when(F.col(frame) < edge(guess), guess - 1)
        .when(F.col(frame) >= edge(guess + 1), guess + 1)
        .otherwise(guess)
    )
    mean_max_range = [("rms", True), ("sc", False), ("sbw", False), ("zcr", False)]
    aggs = []
    for name, is_level in mean_max_range:
        if name not in df.columns:
            continue
        aggs.append(F.avg(name).alias(f"{name}_mean"))
        if is_level:
            aggs += [F.max(name).alias(f"{name}_max"), (F.max(name) - F.min(name)).alias(f"{name}_dyn")]
        else:
            aggs.append(F.stddev_pop(name).alias(f"{name}_std"))
    if "sro" in df.columns:
        aggs.append(F.avg("sro").alias("sro_mean"))
    if "onset" in df.columns:
        aggs += [F.avg("onset").alias("onset_mean"), F.max("onset").alias("onset_max")]
    aggs += [F.avg(F.col("mfcc")[k]).alias(f"mfcc{k}") for k in range(n_mfcc)]
    return df.withColumn("t", t.cast("int")).groupBy("vid", "t").agg(*aggs)
