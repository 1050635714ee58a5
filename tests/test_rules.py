"""Rules that once dropped or bent data: recordings without threats, text ids, ends of recordings, near starts, large overlaps."""

import random
import time

from pyspark.sql import functions as F

from spanforge.operators import attribution as A, intervals as I, season as S, series as R, training as T
from spanforge.plans import evaluation as E, reports as P


def test_recording_without_threats_keeps_its_false_positives(spark):
    gt = spark.createDataFrame([("a", 0, 10.0, 12.0, "A", "Shots", 1), ("b", 1, 5.0, 6.0, "A", "OZ play", 1)], "vid string, idx int, start_s double, end_s double, team string, action string, half int")
    pred = spark.createDataFrame([("a", 0, 10.0, 12.0), ("b", 1, 1.0, 2.0), ("b", 2, 8.0, 9.0), ("z", 3, 8.0, 9.0)], "vid string, pred_id int, start_s double, end_s double")
    for got in (E.eval_strict(gt, pred, 0.3, 0, 2), E.eval_spotting(gt, pred, 5.0, 2)):
        rows = {r.vid: (r.tp, r.fp, r.fn) for r in got.collect()}
        assert rows == {"a": (1, 0, 0), "b": (0, 2, 0), None: (1, 2, 0)}


def test_windows_end_with_the_recording(spark):
    win = spark.createDataFrame([("a", 0, 18, 40, "motion"), ("a", 1, 25, 30, "motion")], "vid string, win_id int, start_s int, end_s int, source string")
    sig = spark.range(20).select(F.lit("a").alias("vid"), F.col("id").cast("int").alias("t"), F.lit(1.0).alias("motion_left"), F.lit(2.0).alias("motion_right"))
    games = spark.createDataFrame([("a", "White", "Navy", "left", "right", [(1, 0, 20)])], "vid string, target_color string, opponent_color string, target_side string, opponent_side string, periods array<struct<num:int,start:int,end:int>>")
    assert [(r.start_s, r.end_s) for r in A.attribute(win, sig, games).collect()] == [(18, 20)]


def test_text_ids(spark):
    c = spark.createDataFrame([(f"g{i}", i % 4) for i in range(40)], "vid string, n int")
    got = T.stratified_split(c, 0.25, 3)
    order = sorted(((i % 4, f"g{i}") for i in range(40)))
    want = sorted(v for k, (_, v) in enumerate(order) if k % 4 == 0)[:10]
    assert sorted(r.vid for r in got.filter("split = 'test'").collect()) == want
    x = spark.createDataFrame([(f"g{i}", float(i), float(2 * i)) for i in range(40)], "vid string, a double, b double")
    r = P.paired_ci(x, "a", "b", 100).first()
    assert r["mean"] == 19.5 and r.ci_lo < 19.5 < r.ci_hi


def test_quantiles_over_all_rows(spark):
    rng = random.Random(1)
    v = [rng.randint(0, 50) for _ in range(999)]
    r = E.index_quantiles(spark.createDataFrame([(x,) for x in v], "x int").repartition(5), "x").first()
    s = sorted(v)
    assert (r.n, r.min, r.p25, r["median"], r.p75, r.max) == (999, s[0], s[249], s[499], s[749], s[-1])


def test_clips_of_two_games_with_near_starts(spark):
    row = lambda no, game, start, conf: ("v", "s", game, no, start, conf, conf, 0, 0, 1, 0, None, None, None)
    ddl = "vid string, season string, game string, clip_no long, start_s int, coaching_confidence int, position_confidence int, goals int, saves int, sog int, n_caveats int, rebound_control_rank string, cover_angle_rank string, squareness_rank string"
    got = S.agenda(S.instruction_score(spark.createDataFrame([row(1, "g1", 10, 5), row(2, "g2", 11, 5), row(3, "g2", 12, 4), row(4, "g2", 90, 1)], ddl)))
    assert sorted(r.clip_no for r in got.collect()) == [1, 2]
    low = S.agenda(S.instruction_score(spark.createDataFrame([row(1, "g1", 10, 1), row(2, "g1", 40, 1)], ddl)))
    assert low.count() == 2


def test_negatives_only_from_games_with_truth(spark):
    feat = spark.createDataFrame([(v, t, 1, 0.9, 1, 5) for v in ("a", "b") for t in (1, 50)], "vid string, t int, n_goal int, goal_conf_max double, n_goalie int, n_player int")
    gt = spark.createDataFrame([("a", 1.0, 2.0, "Red Wolves", "Shots"), ("a", 50.0, 51.0, "Blue Bears", "Shots")], "vid string, start_s double, end_s double, team string, action string")
    assert T.hard_negatives(feat, gt, 9).count() == 0
    opp = spark.createDataFrame([("a", "Blue Bears")], "vid string, opponent string")
    assert [(r.vid, r.t) for r in T.hard_negatives(feat, gt, 9, opponents=opp).collect()] == [("a", 1)]


def loop(rows):
    """Straight-line version of the merge."""
    out = []
    for s, e, _, c in sorted(rows):
        if out and s < out[-1][1]:
            if out[-1][2] == c:
                out[-1][1] = max(out[-1][1], e)
            elif s > out[-1][0]:
                out[-1][1] = s
                out.append([s, e, c])
            else:
                out[-1] = [s, e, c]
        else:
            if out and s > out[-1][1]:
                out.append([out[-1][1], s, "gap"])
            out.append([s, e, c])
    return sorted(map(tuple, out))


def test_merge_of_one_recording_with_many_overlapping_rows(spark):
    rng = random.Random(4)
    rows = [(s := rng.randint(0, 1500), s + rng.randint(1, 12), k, rng.choice("xyz")) for k in range(100_000)]
    df = spark.createDataFrame([("v", s, e, c, k) for s, e, k, c in rows], "vid string, start_s int, end_s int, color string, ord long").withColumn("threat", F.lit(True))
    began = time.time()
    got = I.merge_classified(df).collect()
    assert sorted((r.start_s, r.end_s, r.color or "gap") for r in got) == loop(rows)
    assert time.time() - began < 60


def test_stop_above_open(spark):
    rng = random.Random(6)
    for trial in range(3):
        m = [rng.choice([0.2, 1.1, 1.2, 1.6, 2.0]) for _ in range(300)]
        df = spark.createDataFrame([("v", t, x) for t, x in enumerate(m)], "vid string, t int, motion double")
        got = sorted((r.start_s, r.end_s, r.source) for r in R.hysteresis(df, "motion", 1.0, 1.5, 2 + trial, 6).collect())
        out, run, n, opened = [], None, 0, None
        for t, x in enumerate(m):
            if x >= 1.0:
                run, n = (t if run is None else run), n + 1
                if n >= 2 + trial and opened is None:
                    opened = run
            else:
                run, n = None, 0
            if opened is not None and x < 1.5:
                out.append((opened, t, "motion"))
                opened = None
            elif opened is not None and t - opened >= 6:
                out.append((opened, t, "motion_auto_close"))
                opened, run, n = None, None, 0
        if opened is not None:
            out.append((opened, len(m), "motion_eof"))
        assert got == sorted(out)
