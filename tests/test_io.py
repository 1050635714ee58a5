"""Files: readers, writers and round trips."""

import json
import re

import pytest
from pyspark.sql import functions as F

from spanforge.sources import readers as RD, sinks as K


def test_probs_files(spark, tmp_path):
    (tmp_path / "abc.tsv").write_text("t\tshot_max_conf\tx\n0\t0.5\t1\n1.0\t0.25\t1\nbad\t1\n3\n4\tzz\t0\n")
    (tmp_path / "def.tsv").write_text("9\t9\n1\t0.75\n")
    got = sorted((r.vid, r.t, r.p) for r in RD.read_probs(spark, str(tmp_path)).collect())
    assert got == [("abc", 0, 0.5), ("abc", 1, 0.25), ("def", 1, 0.75)]


def test_events_predictions_boxes(spark, tmp_path):
    g = tmp_path / "gt"
    g.mkdir()
    (g / "gt_17.csv").write_text("start,end,team,action,half\n1,13, A ,Shots,2\nx,2,A,Shots,1\n5,9,B,Goals,\n")
    got = sorted((r.vid, r.start_s, r.team, r.half) for r in RD.read_events(spark, str(g)).collect())
    assert got == [("17", 1.0, "A", 2), ("17", 5.0, "B", 1)]
    p = tmp_path / "p.csv"
    p.write_text("vID,start_s,end_s\n17,1,2\n17,,3\n")
    assert RD.read_predictions(spark, str(p)).count() == 1
    b = tmp_path / "boxes"
    b.mkdir()
    (b / "vid_1_pos_00042.txt").write_text("1 0.5 0.5 0.1 0.2\nbad line\n2 0.1 0.2 0.3 0.4\n")
    got = sorted((r.vid, r.kind, r.t, r.cls, r.line_no) for r in RD.read_boxes(spark, str(b)).collect())
    assert got == [("vid_1", "pos", 42, 1, 0), ("vid_1", "pos", 42, 2, 2)]


def test_json_documents(spark, tmp_path):
    s = tmp_path / "seg"
    s.mkdir()
    seg = {"segmentHasThreat": True, "threat_goalie_color": "White", "segment_start": 1, "segment_end": 9, "source_signals": ["motion"]}
    (s / "gt_seg_a.json").write_text(json.dumps([seg, seg], indent=1))
    (s / "gt_seg_b.json").write_text(json.dumps({"segments": [seg]}))
    (s / "gt_seg_c.json").write_text("{oops")
    assert {r.vid: r["count"] for r in RD.read_segments(spark, str(s)).groupBy("vid").count().collect()} == {"a": 2, "b": 1}
    c = tmp_path / "games.json"
    c.write_text(json.dumps([{"vID": 7, "targetGoalieColor": "Red", "periods": [{"num": 1, "start": 0, "end": 9}]}]))
    r = RD.read_games(spark, str(c)).first()
    assert (r.vid, r.target_color, len(r.periods)) == ("7", "Red", 1)


def test_features_and_reports(spark, tmp_path):
    f = tmp_path / "feat"
    f.mkdir()
    (f / "v.tsv").write_text("t\trms\tzcr\n0\t1.5\tnan\n1\t\t2\nx\t1\t1\n")
    got = sorted((r.t, r.rms, r.zcr) for r in RD.read_features(spark, str(f), ["rms", "zcr"]).collect())
    assert got == [(0, 1.5, 0.0), (1, 0.0, 2.0)]
    e = tmp_path / "rep"
    e.mkdir()
    (e / "eval_1.txt").write_text("video abc\n  predicted goals   4\n precision  —  x\nEnd-to-end (P/R/F1):  P=0.5 R=0.25 F1=0.33\n")
    rep = RD.read_reports(spark, str(e))
    r = RD.parse_reports(rep).first()
    assert (r.predicted_goals, r.goal_p, r.shot_e2e_f1, r.shot_mae) == (4, None, 0.33, None)
    assert RD.latest_report(rep, spark.createDataFrame([("abc",), ("zzz",)], "vid string")).count() == 1


def test_writers(spark, tmp_path):
    cand = spark.createDataFrame([("v", 2, 9.0, "00:09", 0.25), ("v", 1, 5.0, "00:05", 0.5)], "vid string, rank int, t_seconds double, t_mmss string, confidence double")
    vids = spark.createDataFrame([("v",), ("none",)], "vid string")
    K.write_candidates(cand, str(tmp_path / "cand"), vids)
    head = "rank,t_seconds,t_mmss,confidence\n"
    assert (tmp_path / "cand/v.csv").read_text() == head + "1,5.0,00:05,0.5\n2,9.0,00:09,0.25\n"
    assert (tmp_path / "cand/none.csv").read_text() == head
    assert sorted(p.name for p in (tmp_path / "cand").iterdir()) == ["none.csv", "v.csv"]
    seg = spark.createDataFrame([("v", 0, 9, True, ["a", "b"], None), ("w", 3, 4, False, ["a"], 'Red "x"')], "vid string, start_s int, end_s int, threat boolean, src array<string>, color string")
    K.write_segments(seg, str(tmp_path / "seg"), vids=vids)
    assert json.loads((tmp_path / "seg/gt_seg_v.json").read_text()) == [{"segmentHasThreat": True, "segment_start": 0, "segment_end": 9}]
    assert json.loads((tmp_path / "seg/gt_seg_w.json").read_text())[0]["threat_goalie_color"] == 'Red "x"'
    assert json.loads((tmp_path / "seg/gt_seg_none.json").read_text()) == []
    assert [json.loads((tmp_path / f"seg/gt_seg_{v}_meta.json").read_text())["n_segments"] for v in ("v", "w", "none")] == [1, 1, 0]
    K.write_tsv(seg, str(tmp_path / "tsv"))
    assert sorted(r.src for r in spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "tsv")).collect()) == ["a", "a+b"]
    K.write_predictions(seg.withColumn("confidence", F.lit(0.5)).withColumn("team", F.lit("A, B")), str(tmp_path / "pred"))
    assert (tmp_path / "pred/v.csv").read_text() == 'vID,start_s,end_s,confidence,team\nv,0,9,0.5000,"A, B"\n'
    probs = spark.createDataFrame([("v", 1, 0.2), ("v", 0, 0.51239)], "vid string, t int, p double")
    K.write_probs(probs, str(tmp_path / "probs"))
    assert (tmp_path / "probs/v.tsv").read_text() == "t\tshot_max_conf\tshot_n\tgoal_max_conf\n0\t0.5124\t1\t0.0\n1\t0.2000\t0\t0.0\n"
    # a second write replaces documents as a whole, and no other files
    (tmp_path / "probs/notes.txt").write_text("mine")
    K.write_probs(probs.withColumn("vid", F.lit("w")), str(tmp_path / "probs"))
    assert sorted(p.name for p in (tmp_path / "probs").iterdir()) == ["notes.txt", "w.tsv"]


def test_an_aborted_write_leaves_nothing(spark, tmp_path):
    probs = spark.createDataFrame([(f"v{k}", t, 0.5) for k in range(6) for t in range(4)], "vid string, t int, p double")
    K.write_probs(probs, str(tmp_path / "out"))
    before = {p.name: p.read_text() for p in (tmp_path / "out").iterdir()}
    broken = probs.withColumn("p", F.when((F.col("vid") == "v3") & (F.col("t") == 3), F.raise_error(F.lit("lost")).cast("double")).otherwise(0.75))
    with pytest.raises(Exception, match="lost"):
        K.write_probs(broken, str(tmp_path / "out"))
    assert {p.name: p.read_text() for p in (tmp_path / "out").iterdir()} == before and len(before) == 6


def test_run_log_appends_and_publish_replaces(spark, tmp_path):
    d = str(tmp_path)
    p = spark.createDataFrame([("a", 5), ("b", 3)], "vid string, shots int")
    t = spark.createDataFrame([("a", 4)], "vid string, shots int")
    for _ in range(2):
        K.append_run_log(p, t, d + "/log")
    log = RD.read_run_log(spark, d + "/log")
    assert log.count() == 4 and {r.delta["shots"] for r in log.filter("vid = 'a'").collect()} == {1}
    docs = spark.createDataFrame([("a", "x"), ("b", "y")], "vid string, body string")
    ok = lambda *good: spark.createDataFrame([(v, v in good) for v in "ab"], "vid string, ok boolean")
    K.publish(docs, ok("a", "b"), d + "/pub")
    K.publish(docs.withColumn("body", F.lit("new")), ok("a"), d + "/pub")
    assert {r.vid: r.body for r in spark.read.json(d + "/pub").collect()} == {"a": "new", "b": "y"}


def test_pending_and_purge(spark):
    ids = spark.createDataFrame([(i,) for i in range(5)], "vid int")
    a, b = ids.filter("vid < 3"), ids.filter("vid % 2 = 0")
    assert sorted(r.vid for r in K.pending(ids, a, b).collect()) == [1, 3, 4]
    refs = spark.createDataFrame([(1, "v_1_0_9"), (2, "v_10_0_9"), (3, "v_1"), (4, "w_3_4")], "id int, clip string")
    kept, gone = K.purge_refs(refs, spark.createDataFrame([("v_1",)], "vid string"), "clip", "id")
    assert sorted(r.id for r in kept.collect()) == [2, 4] and gone.count() == 2


def test_files_of_one_folder_may_order_columns_differently(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("t\trms\tzcr\n0\t1\t2\n1\t3\n")
    (tmp_path / "b.tsv").write_text("zcr\tt\trms\n2\t0\t1\n")
    got = sorted((r.vid, r.t, r.rms, r.zcr) for r in RD.read_features(spark, str(tmp_path), ["rms", "zcr", "none"]).collect())
    assert got == [("a", 0, 1.0, 2.0), ("b", 0, 1.0, 2.0)]
    p = tmp_path / "p"
    p.mkdir()
    (p / "x.csv").write_text('vID,start_s,end_s,confidence,team\n7,1,2,0.5,"A, B"\n')
    (p / "y.csv").write_text("team,end_s,start_s,vID\nC,4,3,8\n")
    got = sorted((r.vid, r.start_s, r.end_s, r.confidence, r.team) for r in RD.read_predictions(spark, str(p)).collect())
    assert got == [("7", 1.0, 2.0, 0.5, "A, B"), ("8", 3.0, 4.0, None, "C")]


def test_wide_files_of_several_headers_are_scanned_without_a_shuffle(spark, tmp_path):
    names = [f"f{k}" for k in range(100)]
    (tmp_path / "a b{1}.tsv").write_text("\t".join(["t", *names]) + "\n" + "\n".join("\t".join([str(t), *(str(k + t) for k in range(100))]) for t in range(3)) + "\n5\tshort\n")
    (tmp_path / "c.tsv").write_text("\t".join([*reversed(names), "t"]) + "\n" + "\t".join([*(str(99 - k) for k in range(100)), "7"]) + "\n")
    (tmp_path / "headless.tsv").write_text("1\t2\n")
    (tmp_path / "empty.tsv").write_text("")
    got = RD.read_features(spark, str(tmp_path), names)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    rows = {(r.vid, r.t): [r[n] for n in names] for r in got.collect()}
    assert rows == {**{("a b{1}", t): [float(k + t) for k in range(100)] for t in range(3)}, ("c", 7): [float(k) for k in range(100)]}
    assert RD.read_features(spark, str(tmp_path / "headless.tsv"), names).count() == 0


def test_writers_are_read_back(spark, tmp_path):
    d = str(tmp_path)
    seg = spark.createDataFrame([("v1", 0, 9, True, "Red", ["a"]), ("v1", 9, 12, False, None, None), ("v2", 3, 5, True, "Blue", ["b"])], "vid string, start_s int, end_s int, threat boolean, color string, source_signals array<string>")
    K.write_segments(seg, d + "/seg")
    got = sorted((r.vid, r.start_s, r.end_s, r.threat, r.color) for r in RD.read_segments(spark, d + "/seg/gt_seg_v?.json").collect())
    assert got == [("v1", 0.0, 9.0, True, "Red"), ("v1", 9.0, 12.0, False, None), ("v2", 3.0, 5.0, True, "Blue")]
    probs = spark.createDataFrame([("v1", 0, 0.5), ("v1", 1, 0.25), ("v2", 0, 0.125)], "vid string, t int, p double")
    K.write_probs(probs, d + "/probs")
    assert sorted((r.vid, r.t, r.p) for r in RD.read_probs(spark, d + "/probs").collect()) == [("v1", 0, 0.5), ("v1", 1, 0.25), ("v2", 0, 0.125)]
    points = spark.createDataFrame([("v1", 7.5, 0.9, "A")], "vid string, t double, confidence double, team string")
    K.write_predictions(points, d + "/points")
    r = RD.read_predictions(spark, d + "/points").first()
    assert (r.vid, r.start_s, r.end_s, r.confidence, r.team) == ("v1", 7.5, 7.5, 0.9, "A")


def test_report_names_an_id_inside_a_file_name(spark):
    rep = spark.createDataFrame([("old", 1, "video SX5x"), ("new", 2, "from gt_metrics_SX5x.json"), ("other", 3, "SX5xy")], "path string, mtime int, value string")
    ids = spark.createDataFrame([("SX5x",)], "vid string")
    assert [tuple(r) for r in RD.latest_report(rep, ids).collect()] == [("SX5x", "new")]


def test_latest_report_takes_each_word_once_before_it_meets_ids(spark):
    """Words that all reports hold are one row a task; cuts at ``_`` and ``-``, ties and missing times count as before."""
    texts = ["all done a_b-c", "all x--y_z,a_b", "_q- all", "done c d-e_f-g", "", None, "b all"]
    rows = [(f"p{k:02}", None if k % 5 == 0 else k % 3, texts[k % 7]) for k in range(40)]
    reports = spark.createDataFrame(rows, "path string, mtime long, value string")
    ids = ["a", "b", "c", "a_b", "b-c", "a_b-c", "x--y_z", "y", "z", "_q-", "q", "d-e", "e_f", "g", "none"]
    got = RD.latest_report(reports, spark.createDataFrame([(i,) for i in [*ids, "a"]], "vid string"))
    want = {}
    for path, mtime, text in rows:
        for i in {w for p in (r"[^A-Za-z0-9_-]+", r"[^A-Za-z0-9-]+", r"[^A-Za-z0-9_]+", r"[^A-Za-z0-9]+") for w in re.split(p, text or "")} & set(ids):
            want[i] = max(want.get(i, (-1, "")), (-1 if mtime is None else mtime, path))
    assert {r.vid: r.path for r in got.collect()} == {i: path for i, (_, path) in want.items()}
    assert "LeftSemi" not in got._jdf.queryExecution().optimizedPlan().toString()
