"""Readers: every format is a plain Spark scan plus a column-level parser.

``parse_*`` turn text rows into typed tables and drop what cannot be read;
``read_*`` add the scan and take the recording id from the file name.
"""

from __future__ import annotations

import csv
import functools
import re
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, functions as F



def _stem(path: Column, pattern: str = r"([^/]+?)(\.[A-Za-z0-9]+)+$") -> Column:
    """Recording id: from a folder ``vid=<id>``, as the writers make them, else from the file name."""
    path = F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))  # Spark names files by encoded addresses
    folder = F.regexp_extract(path, r"/vid=([^/]+)/[^/]*$", 1)
    return F.when(folder != "", folder).otherwise(F.regexp_extract(path, pattern, 1))


def _file(uri: str) -> str:
    """A file's address as a path to read: decoded, and with the signs of patterns taken literally."""
    return re.sub(r"([\\{}\[\]*?])", r"\\\1", unquote(uri))


def _by_header(spark: SparkSession, path: str, sep: str, mark: str, cols: list[str], strict: bool = False) -> DataFrame:
    """Named text columns of delimited files, each read by its own header line.

    A header line has a field ``mark``, which no data line has.  Files are grouped by
    their header text, of which there are few; each group is one scan with that header's
    columns, and the scans are unioned.  So files may order columns differently and have
    any number of them, and no line is ever shuffled.  Columns a file lacks are null;
    ``strict`` drops lines of another width; files without a header line have no rows.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), "value").filter(F.contains("value", F.lit(mark)))
    fields = F.transform(F.split("value", re.escape(sep)), lambda c: F.trim(F.replace(F.trim(c), F.lit('"'))))
    first = lines.filter(F.array_contains(fields, mark)).groupBy("path").agg(F.first("value").alias("head"))
    heads = first.groupBy("head").agg(F.collect_list("path").alias("files")).collect()  # one row a header; the driver lists the files anyway
    scans = []
    for head, files in heads:
        names = [c.strip() for c in next(csv.reader([head], delimiter=sep))]
        schema = ", ".join([*(f"c{k} string" for k in range(len(names))), "__bad string"])
        x = spark.read.schema(schema).options(
            sep=sep, header=True, enforceSchema=True, columnNameOfCorruptRecord="__bad", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True
        ).csv([_file(f) for f in files])
        x = x.filter(F.coalesce(F.col(f"c{names.index(mark)}"), F.lit("")) != mark)  # a header line again
        x = x.filter("__bad is null") if strict else x
        scans.append(x.select(F.col("_metadata.file_path").alias("path"), *[(F.col(f"c{names.index(c)}") if c in names else F.lit(None).cast("string")).alias(c) for c in cols]))
    if not scans:
        return spark.createDataFrame([], ", ".join(f"`{c}` string" for c in ["path", *cols]))
    return functools.reduce(DataFrame.unionByName, scans)


def _seconds(c: Column) -> Column:
    return F.trim(c).try_cast("double").try_cast("int")


# -- series ------------------------------------------------------------------


def parse_probs(rows: DataFrame) -> DataFrame:
    """``(vid, c0, c1)`` text columns to ``(vid, t, p)``; bad rows dropped."""
    x = rows.select("vid", _seconds(F.col("c0")).alias("t"), F.trim("c1").try_cast("double").alias("p"))
    return x.filter("t is not null and p is not null")


def read_probs(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated ``t, p, ...`` with a header line per file."""
    raw = spark.read.option("sep", "\t").option("header", True).option("enforceSchema", True).schema("c0 string, c1 string").csv(path)
    return parse_probs(raw.withColumn("vid", _stem(F.col("_metadata.file_path"))))


def parse_features(rows: DataFrame, cols: list[str], sentinel: float = 0.0) -> DataFrame:
    """Named text columns to doubles; blanks, ``nan`` and text become ``sentinel``."""
    num = lambda c: F.coalesce(F.nanvl(F.trim(c).try_cast("double"), F.lit(sentinel)), F.lit(sentinel)).alias(c)
    return rows.select("vid", _seconds(F.col("t")).alias("t"), *[num(c) for c in cols]).filter("t is not null")


def read_features(spark: SparkSession, path: str, cols: list[str]) -> DataFrame:
    """Feature TSV addressed by header names; rows of wrong width dropped."""
    raw = _by_header(spark, path, "\t", "t", ["t", *cols], strict=True)
    return parse_features(raw.withColumn("vid", _stem(F.col("path"))), cols)


# -- events and predictions ----------------------------------------------------


def parse_events(rows: DataFrame) -> DataFrame:
    """Ground-truth text rows to events; a missing half means the first."""
    num = lambda c: F.trim(c).try_cast("double")
    half = F.when(F.coalesce(F.trim("half"), F.lit("")) == "", F.lit(1)).otherwise(F.trim("half").try_cast("int"))
    text = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    keep = [c for c in rows.columns if c not in ("start", "end", "team", "action", "half")]
    x = rows.select(*keep, num("start").alias("start_s"), num("end").alias("end_s"), text("team").alias("team"), text("action").alias("action"), half.alias("half"))
    return x.filter("start_s is not null and end_s is not null and half is not null")


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Files ``gt_<id>.csv`` with ``start,end,team,action,half``."""
    raw = _by_header(spark, path, ",", "start", ["start", "end", "team", "action", "half"])
    return parse_events(raw.withColumn("vid", F.regexp_extract("path", r"gt_([^/]+?)\.csv$", 1)).drop("path"))


def parse_predictions(rows: DataFrame) -> DataFrame:
    """``vID,start_s,end_s[,confidence,team]`` text rows; bad rows dropped."""
    opt = lambda c: F.col(c) if c in rows.columns else F.lit(None).cast("string")
    x = rows.select(
        F.trim("vID").alias("vid"), F.trim("start_s").try_cast("double").alias("start_s"), F.trim("end_s").try_cast("double").alias("end_s"),
        F.trim(opt("confidence")).try_cast("double").alias("confidence"), F.nullif(F.trim(opt("team")), F.lit("")).alias("team"),
    )
    return x.filter("vid is not null and start_s is not null and end_s is not null")


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    return parse_predictions(_by_header(spark, path, ",", "vID", ["vID", "start_s", "end_s", "confidence", "team"]))


# -- JSON documents ------------------------------------------------------------

# Fixed schemas.
SEGMENT = (
    "struct<segmentHasThreat:boolean,threat_goalie_color:string,threat_goalie_side:string,segment_start:double,segment_end:double,"
    "source_signals:array<string>,n_overlapping_raw:int>"
)
GAME = (
    "struct<vID:string,targetGoalieColor:string,opponentGoalieColor:string,targetGoalieTeamName:string,opponentGoalieTeamName:string,"
    "targetStartSide:string,opponentStartSide:string,periods:array<struct<num:int,start:int,end:int>>,"
    "manual_goals_logged:array<struct<start_time:double,end_time:double>>>"
)


def _list_or(doc: Column, item: str, wrapped: Column) -> Column:
    """A JSON list of items, else whatever ``wrapped`` finds."""
    is_list = F.startswith(F.trim(doc), F.lit("["))
    return F.when(is_list, F.from_json(doc, f"array<{item}>")).otherwise(wrapped)


def parse_segments(docs: DataFrame) -> DataFrame:
    """``(vid, doc)``: a flat list, ``{"segments": [...]}`` or a segment per line; bad text gives none."""
    lines = F.filter(F.transform(F.split("doc", "\n"), lambda x: F.from_json(x, SEGMENT)), lambda s: s["segment_start"].isNotNull())
    inner = F.coalesce(F.from_json("doc", f"segments array<{SEGMENT}>")["segments"], lines)
    x = docs.select("vid", F.posexplode(_list_or(F.col("doc"), SEGMENT, inner)).alias("ord", "s")).filter("s is not null")
    return x.select(
        "vid", "ord", F.col("s.segment_start").alias("start_s"), F.col("s.segment_end").alias("end_s"), F.coalesce("s.segmentHasThreat", F.lit(False)).alias("threat"),
        F.col("s.threat_goalie_color").alias("color"), F.col("s.threat_goalie_side").alias("side"), F.col("s.source_signals").alias("source_signals"),
        F.col("s.n_overlapping_raw").alias("n_overlapping_raw"),
    )


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """One document per file ``gt_seg_<vid>.json``; sidecars beside them are not read."""
    raw = spark.read.text(path, wholetext=True).select(_stem(F.col("_metadata.file_path"), r"gt_seg_([^/]+?)\.json$").alias("vid"), F.col("value").alias("doc"))
    return parse_segments(raw)


def parse_games(docs: DataFrame) -> DataFrame:
    """``(doc)``: a list of game records or a single one; ids become text."""
    one = F.array(F.from_json("doc", GAME))
    g = docs.select(F.explode(_list_or(F.col("doc"), GAME, one)).alias("g")).filter("g.vID is not null")
    return g.select(
        F.col("g.vID").alias("vid"), F.col("g.targetGoalieTeamName").alias("target_team"), F.col("g.opponentGoalieTeamName").alias("opponent_team"),
        F.col("g.targetGoalieColor").alias("target_color"), F.col("g.opponentGoalieColor").alias("opponent_color"), F.col("g.targetStartSide").alias("target_side"),
        F.col("g.opponentStartSide").alias("opponent_side"), F.col("g.periods").alias("periods"), F.col("g.manual_goals_logged").alias("manual_goals"),
    )


def read_games(spark: SparkSession, path: str) -> DataFrame:
    return parse_games(spark.read.text(path, wholetext=True).select(F.col("value").alias("doc")))


def with_sidecar(df: DataFrame, side: DataFrame, key: str = "vid") -> DataFrame:
    """Optional sidecar columns, null where the sidecar is missing."""
    return df.join(side, key, "left")


RUN = "struct<ts:string,vID:string,predicted:map<string,int>,ground_truth:map<string,int>,delta:map<string,int>>"


def parse_run_log(lines: DataFrame) -> DataFrame:
    """``(value)`` JSON lines; lines that are not JSON objects are skipped."""
    x = lines.select(F.from_json("value", RUN).alias("r"), F.try_parse_json("value").isNotNull().alias("ok"))
    return x.filter("ok and r.vID is not null").select("r.ts", F.col("r.vID").alias("vid"), "r.predicted", "r.ground_truth", "r.delta")


def read_run_log(spark: SparkSession, path: str) -> DataFrame:
    return parse_run_log(spark.read.text(path))


# -- box labels ----------------------------------------------------------------


def parse_boxes(lines: DataFrame) -> DataFrame:
    """``(file_name, line_no, value)``: five numbers a line, the rest dropped.

    The file name carries ``<vid>_<pos|neg|hardneg>_<second>``.
    """
    parts = F.split(F.trim("value"), r"\s+")
    pat = r"^(.*)_(pos|neg|hardneg2?)_(\d+)"
    num = lambda i: F.get(parts, F.lit(i)).try_cast("double")
    x = lines.filter(F.size(parts) == 5).select(
        F.regexp_extract("file_name", pat, 1).alias("vid"), F.regexp_extract("file_name", pat, 2).alias("kind"),
        F.regexp_extract("file_name", pat, 3).try_cast("int").alias("t"), "line_no", F.get(parts, F.lit(0)).try_cast("int").alias("cls"),
        num(1).alias("cx"), num(2).alias("cy"), num(3).alias("w"), num(4).alias("h"),
    )
    return x.filter("cls is not null and cx is not null and cy is not null and w is not null and h is not null")


def read_boxes(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file_name"), F.posexplode(F.split("value", "\n")).alias("line_no", "value"))
    return parse_boxes(raw)


# -- text reports ----------------------------------------------------------------

# Fixed patterns: type of each figure of a text report, and where it stands.
REPORT_PATTERNS = {
    "predicted_goals": ("int", r"^\s*predicted goals\s+(\d+)"),
    "actual_goals": ("int", r"^\s*actual goals\s+(\d+)"),
    "predicted_shots": ("int", r"^\s*predicted shots\s+(\d+)"),
    "actual_shots": ("int", r"^\s*actual shots\s+(\d+)"),
    "shot_mae": ("double", r"^\s*mean abs error \(MAE\)\s+([0-9.]+)"),
    "n_windows": ("int", r"^\s*windows compared:\s+(\d+)"),
    "goal_p": ("double", r"^\s*precision\s+([0-9.]+|—|nan)\s+"),
    "goal_r": ("double", r"^\s*recall\s+([0-9.]+|—|nan)\s+"),
    "goal_f1": ("double", r"^\s*F1\s+([0-9.]+|—|nan)\s+"),
    "goal_tp": ("int", r"^\s*TP\s+(\d+)\s+"),
    "goal_fp": ("int", r"^\s*FP\s+(\d+)\s+"),
    "goal_fn": ("int", r"^\s*FN\s+(\d+)\s+"),
    "shot_e2e_p": ("double", r"End-to-end \(P/R/F1\):\s+P=([0-9.]+)"),
    "shot_e2e_r": ("double", r"End-to-end \(P/R/F1\):\s+P=[0-9.]+\s+R=([0-9.]+)"),
    "shot_e2e_f1": ("double", r"End-to-end \(P/R/F1\):\s+P=[0-9.]+\s+R=[0-9.]+\s+F1=([0-9.]+)"),
    "shot_inwin_p": ("double", r"Within-coverage\s+\(P/R/F1\):\s+P=([0-9.]+)"),
    "shot_inwin_r": ("double", r"Within-coverage\s+\(P/R/F1\):\s+P=[0-9.]+\s+R=([0-9.]+)"),
    "shot_inwin_f1": ("double", r"Within-coverage\s+\(P/R/F1\):\s+P=[0-9.]+\s+R=[0-9.]+\s+F1=([0-9.]+)"),
}


def parse_reports(docs: DataFrame, text: str = "value") -> DataFrame:
    """Named figures of each text report; a dash or ``nan`` reads as null."""
    out = []
    for k, (kind, pat) in REPORT_PATTERNS.items():
        got = F.regexp_extract(text, "(?m)" + pat, 1)
        out.append(F.when(~got.isin("", "—", "nan"), got.try_cast(kind)).alias(k))
    return docs.select(*[c for c in docs.columns if c != text], *out)


def _words(text: str) -> Column:
    """Different runs of letters, digits, ``_`` and ``-``, and what is left of each if either or both of these end a word."""
    runs = F.split(F.regexp_replace(text, "[^A-Za-z0-9_-]+", " "), " ")
    cut = lambda w: F.concat(F.array(w), F.split(w, "_"), F.split(w, "-"), F.split(F.translate(w, "_", "-"), "-"))
    return F.array_distinct(F.flatten(F.transform(runs, lambda w: F.when(F.contains(w, F.lit("_")) | F.contains(w, F.lit("-")), cut(w)).otherwise(F.array(w)))))


def latest_report(reports: DataFrame, vids: DataFrame) -> DataFrame:
    """Newest report naming each recording.

    ``reports``: ``(path, mtime, value)``.  Reports are cut into words, with and
    without ``_`` and ``-`` as part of a word, and joined on the id, so ids are not
    searched for one by one and are found inside file names.  An id that is part of a
    longer run of letters and digits is not found.

    Each word's latest time is taken first, which combines on the map side, so a word that
    all reports hold is one row a task; then the reports of that time are looked up by hash.
    """
    words = reports.select("path", "mtime", F.explode(_words("value")).alias("vid")).filter("vid <> ''")
    ids = vids.select(F.col("vid").cast("string").alias("vid")).distinct()
    # an inner join: a semi-join would be moved before the aggregate, to all words
    last = words.groupBy("vid").agg(F.max("mtime").alias("last")).join(ids.hint("shuffle_hash"), "vid").withColumnRenamed("vid", "id")
    hit = words.join(last.hint("shuffle_hash"), F.expr("vid = id and mtime <=> last"))
    return hit.groupBy("vid").agg(F.max("path").alias("path"))


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("mtime"), "value"
    )


def paired_ids(videos: DataFrame, truths: DataFrame) -> DataFrame:
    """Numeric ids that have both a video and a ground-truth file."""
    v = videos.select(F.regexp_extract("path", r"(?:^|/)(?:full_)?(\d+)\.mp4$", 1).try_cast("bigint").alias("vid"))
    g = truths.select(F.regexp_extract("path", r"(?:^|/)gt_(\d+)\.csv$", 1).try_cast("bigint").alias("vid"))
    return v.filter("vid is not null").intersect(g.filter("vid is not null"))
