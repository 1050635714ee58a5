"""Writers.  Each writes in parallel from its partitions; nothing is collected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import clip_id
from .files import write_documents


def _line(sep: str, *columns: Column) -> Column:
    """A delimited line; values with the separator, quotes or line ends are quoted."""
    return F.concat(F.to_csv(F.struct(*columns), {"sep": sep, "escapeQuotes": "true", "nullValue": "", "emptyValue": ""}), F.lit("\n"))


def write_candidates(df: DataFrame, path: str, vids: DataFrame | None = None) -> None:
    """Ranked candidates as ``<vid>.csv`` with a header, also for a recording of ``vids`` without any."""
    columns = ["rank", "t_seconds", "t_mmss", "confidence"]
    write_documents(df, ["rank"], _line(",", *map(F.col, columns)), path, "{vid}.csv", ",".join(columns) + "\n", vids=vids)


def segment_meta(df: DataFrame, method: str) -> DataFrame:
    """Sidecar rows: segment count, method and processing time."""
    return df.groupBy("vid").agg(F.count("*").alias("n_segments"), F.lit(method).alias("method"), F.max(F.current_timestamp()).alias("processed_at"))


#: fields of a segment document and the columns they come from (fixed names)
SEGMENT_FIELDS = {
    "segmentHasThreat": "threat", "threat_goalie_color": "color", "threat_goalie_side": "side", "segment_start": "start_s", "segment_end": "end_s",
    "source_signals": "source_signals", "n_overlapping_raw": "n_overlapping_raw",
}


def segment_rows(df: DataFrame, *keep: str) -> DataFrame:
    """One JSON text per segment, in the fields ``read_segments`` reads, next to the columns to keep."""
    fields = [F.col(c).alias(k) for k, c in SEGMENT_FIELDS.items() if c in df.columns]
    return df.select("vid", *keep, F.to_json(F.struct(*fields)).alias("value"))


def write_segments(df: DataFrame, path: str, method: str = "fusion", vids: DataFrame | None = None) -> None:
    """Segments as one JSON list per recording, ``gt_seg_<vid>.json``, with a sidecar ``gt_seg_<vid>_meta.json``.

    A recording of ``vids`` without segments gets an empty list and a sidecar that counts none.
    """
    rows = segment_rows(df.withColumn("__s", F.col("start_s")).withColumn("__e", F.col("end_s")), "__s", "__e")
    write_documents(rows, ["__s", "__e", "value"], F.concat(F.lit("\n  "), "value"), path, "gt_seg_{vid}.json", "[", ",", "\n]\n", vids)
    meta = segment_meta(df, method)
    if vids is not None:
        none = F.lit(0).cast("long").alias("n_segments"), F.lit(method).alias("method"), F.current_timestamp().alias("processed_at")
        meta = meta.unionByName(vids.select("vid").distinct().join(meta.select("vid"), "vid", "left_anti").select("vid", *none))
    write_documents(meta, [], F.to_json(F.struct("vid", "n_segments", "method", "processed_at")), path, "gt_seg_{vid}_meta.json", tail="\n")


def write_predictions(df: DataFrame, path: str) -> None:
    """Prediction CSV ``vID,start_s,end_s,confidence[,team]`` with four decimals, one ``<vid>.csv`` a recording.

    Points ``(vid, t, confidence)`` become windows of no length.
    """
    if "t" in df.columns and "start_s" not in df.columns:
        df = df.withColumn("start_s", F.col("t")).withColumn("end_s", F.col("t"))
    team = ["team"] if "team" in df.columns else []
    columns = [F.col("vid").alias("vID"), F.col("start_s"), F.col("end_s"), four_decimals(F.col("confidence")), *map(F.col, team)]
    write_documents(df, ["start_s", "end_s"], _line(",", *columns), path, "{vid}.csv", ",".join(["vID", "start_s", "end_s", "confidence", *team]) + "\n")


def write_tsv(df: DataFrame, path: str) -> None:
    """Tab-separated table, nulls empty; arrays are joined with ``+``."""
    flat = [F.array_join(c, "+").alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes]
    df.select(*flat).write.mode("overwrite").option("header", True).option("sep", "\t").option("nullValue", "").option("emptyValue", "").csv(path)


def four_decimals(p: Column) -> Column:
    """A score between 0 and 1 with four decimals, rounded by its exact value, ties to the even digit.

    ``format_string`` rounds the shortest decimal form half up, which goes wrong where a
    five is the last digit.  The score is split in two parts whose products with 10,000
    are exact, so the remainder over a half has the right sign.
    """
    high = F.floor(p * 2**26) / 2**26
    y, z = high * 10_000, (p - high) * 10_000
    n = F.floor(y)
    over = (y - n - 0.5) + z
    n = n + ((over > 0) | ((over == 0) & (n % 2 == 1))).cast("long")
    return F.concat(F.floor(n / 10_000).cast("string"), F.lit("."), F.lpad((n % 10_000).cast("string"), 4, "0"))


def prob_rows(df: DataFrame) -> DataFrame:
    """Series rows as written: four decimals and the ``p > 0.5`` flag."""
    return df.select("vid", "t", four_decimals(F.col("p")).alias("shot_max_conf"), (F.col("p") > 0.5).cast("int").alias("shot_n"), F.lit("0.0").alias("goal_max_conf"))


def write_probs(df: DataFrame, path: str, vids: DataFrame | None = None) -> None:
    """One ``<vid>.tsv`` a recording, in time order."""
    columns = ["t", "shot_max_conf", "shot_n", "goal_max_conf"]
    write_documents(prob_rows(df), ["t"], _line("\t", *map(F.col, columns)), path, "{vid}.tsv", "\t".join(columns) + "\n", vids=vids)


def run_log_rows(pred: DataFrame, truth: DataFrame) -> DataFrame:
    """Log records with totals, truth where known and the difference."""
    keys = [c for c in pred.columns if c != "vid"]
    t = truth.select("vid", F.struct(*keys).alias("ground_truth"))
    x = pred.select("vid", F.struct(*keys).alias("predicted")).join(t, "vid", "left")
    delta = F.when(
        F.col("ground_truth").isNotNull(), F.struct(*[(F.col(f"predicted.{k}") - F.col(f"ground_truth.{k}")).alias(k) for k in keys])
    )
    return x.select(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ts"), F.col("vid").alias("vID"), "predicted", "ground_truth", delta.alias("delta"))


def append_run_log(pred: DataFrame, truth: DataFrame, path: str) -> None:
    run_log_rows(pred, truth).write.mode("append").json(path)


def publishable(docs: DataFrame, status: DataFrame) -> DataFrame:
    """Documents of recordings whose stages all succeeded."""
    good = status.groupBy("vid").agg(F.bool_and("ok").alias("ok")).filter("ok").select("vid")
    return docs.join(good, "vid", "left_semi")


def publish(docs: DataFrame, status: DataFrame, path: str) -> None:
    """Replace the published documents of finished recordings only."""
    publishable(docs, status).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("vid").json(path)


def pending(df: DataFrame, *existing: DataFrame, key: str = "vid") -> DataFrame:
    """Ids missing from at least one destination: what a rerun still has to do."""
    done = existing[0].select(key)
    for e in existing[1:]:
        done = done.join(e.select(key), key, "left_semi")
    return df.join(done.distinct(), key, "left_anti")


def upsert(df: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """Overwrite fields of matching records; other records and fields stay."""
    fields = [c for c in updates.columns if c != key]
    u = updates.select(key, F.lit(True).alias("__u"), *[F.col(c).alias(f"__{c}") for c in fields])
    x = df.join(u, key, "left")
    return x.select(*[F.when(F.col("__u"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in df.columns])


def purge_refs(table: DataFrame, vids: DataFrame, clip_col: str, id_col: str) -> tuple[DataFrame, DataFrame]:
    """Drop rows that refer to purged recordings; returns ``(kept, removed)``.

    ``table`` has one reference per row (favourites, feedback, validations, or
    exploded playlist and share items).  The stems of each id are matched with
    an equi-join, so the purge list is never compared row by row.
    """
    parts = F.split(F.col(clip_col), "_")
    stems = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "_"))
    hit = (
        table.select(id_col, F.explode(stems).alias("__vid"))
        .join(vids.select(F.col("vid").cast("string").alias("__vid")).distinct(), "__vid", "left_semi")
        .select(id_col).distinct()
    )
    return table.join(hit, id_col, "left_anti"), table.join(hit, id_col, "left_semi")


def purge_counts(**removed: DataFrame) -> DataFrame:
    """Number of removed references per kind."""
    out = None
    for kind, df in removed.items():
        row = df.agg(F.count("*").alias("removed")).select(F.lit(kind).alias("kind"), "removed")
        out = row if out is None else out.unionByName(row)
    return out


def shrink_lists(lists: DataFrame, items: DataFrame, kept: DataFrame, id_col: str, clip_col: str = "clip_id") -> DataFrame:
    """Playlists or shares after a purge: kept items and whether to revoke.

    A list that had items and lost all of them is revoked.
    """
    had = items.groupBy(id_col).agg(F.count("*").alias("__had"))
    left = kept.groupBy(id_col).agg(F.count("*").alias("n_items"))
    x = lists.join(had, id_col, "left").join(left, id_col, "left").na.fill(0, ["__had", "n_items"])
    return x.withColumn("revoked", (F.col("__had") > 0) & (F.col("n_items") == 0)).drop("__had")


def injected_log(seg: DataFrame, games: DataFrame) -> DataFrame:
    """One feedback-log row per injected goal segment."""
    x = seg.filter(F.col("source_signals") == F.array(F.lit("manual_goal"))).join(games.select("vid", "opponent_team"), "vid", "left")
    return x.select(
        F.expr("uuid()").alias("log_id"), F.current_timestamp().alias("timestamp"), F.col("vid").alias("video_id"),
        clip_id(F.col("vid"), F.col("start_s"), F.col("end_s")).alias("clip_id"),
        F.struct(F.col("start_s").alias("start_time"), F.col("end_s").alias("end_time")).alias("ai_metadata"),
        F.struct(F.lit("valid").alias("status"), F.lit("ai_missed_goal_injected").alias("action_taken")).alias("user_validation"),
        F.lit(True).alias("has_matching_manual_goal"),
        F.struct("opponent_team", F.lit("pipeline").alias("user_role")).alias("context"),
    )

