"""Series operators against straight-line loops on random input."""

import random

import pytest
from pyspark.sql import functions as F

from spanforge.operators import series as S


def loop_peaks(p, thr, d):
    cand = []
    for i, v in enumerate(p):
        left = p[i - 1] if i else -1
        right = p[i + 1] if i + 1 < len(p) else -1
        if v >= thr and v >= left and v > right:
            cand.append((v, i))
    kept, gone = [], set()
    for v, t in sorted(cand, reverse=True):
        if t not in gone:
            kept.append(t)
            gone.update(range(t - d, t + d + 1))
    return sorted(kept)


@pytest.mark.parametrize("block", [7, 50, 900])
def test_peaks_match_loop_with_ties(spark, block):
    rnd = random.Random(block)
    data = {f"v{k}": [rnd.choice([0.1, 0.3, 0.5, 0.5, 0.9, 1.0]) for _ in range(rnd.randint(1, 120))] for k in range(12)}
    data["ramp"] = [x / 200 for i in range(60) for x in (i + 100, 0)]
    data["flat"] = [v for _ in range(40) for v in (1.0, 0.0)]
    df = spark.createDataFrame([(k, t, v) for k, p in data.items() for t, v in enumerate(p)], "vid string, t int, p double")
    got = {k: [] for k in data}
    for r in S.nms(S.local_maxima(df, 0.3, block=block), 5, block=block).collect():
        got[r.vid].append(r.t)
    fused = {k: [] for k in data}
    for r in S.find_peaks(df, 1, 0.3, 5, block=block).collect():
        fused[r.vid].append(r.t)
    for k, p in data.items():
        want = loop_peaks(p, 0.3, 5)
        assert sorted(got[k]) == want
        assert sorted(fused[k]) == want


@pytest.mark.parametrize("k", [3, 5])
def test_smooth_repeats_edges(spark, k):
    p = [0.1, 0.2, 0.8, 0.3, 0.0, 0.9, 0.4]
    df = spark.createDataFrame([("v", t, v) for t, v in enumerate(p)], "vid string, t int, p double")
    h = k // 2
    pad = [p[0]] * h + p + [p[-1]] * h
    want = [sum(pad[i : i + k]) / k for i in range(len(p))]
    got = [r.p for r in S.smooth(df, k, block=2).orderBy("t").collect()]
    assert got == pytest.approx(want)
    with pytest.raises(ValueError):
        S.smooth(df, 4)


def test_fuse_literals(spark):
    a, b = [0.1, 0.2, 0.8, 0.3], [0.0, 0.5, 0.4, 0.7]
    rows = [("x", "a", t, v) for t, v in enumerate(a)] + [("x", "b", t, v) for t, v in enumerate(b)]
    rows += [("only_a", "a", 0, 0.4), ("short", "a", 9, 1.0), ("short", "b", 2, 1.0)]
    df = spark.createDataFrame(rows, "vid string, channel string, t int, p double")
    out = {(r.vid, r.t): r.p for r in S.fuse(df, {"a": 0.5, "b": 0.5}, block=2).collect()}
    assert out["x", 2] == pytest.approx(0.6)
    assert out["only_a", 0] == pytest.approx(0.4)
    assert sorted(t for v, t in out if v == "short") == [0, 1, 2]


def loop_hysteresis(rows, dur, a, b, n, m):
    run = op = None
    ln, out = 0, []
    for t, x in rows:
        if x >= a:
            run = t if run is None else run
            ln += 1
            if ln >= n and op is None:
                op = run
        else:
            run, ln = None, 0
        if op is not None and x < b:
            out.append((op, t, "motion"))
            op = None
        if op is not None and t - op >= m:
            out.append((op, t, "motion_auto_close"))
            op, run, ln = None, None, 0
    if op is not None:
        out.append((op, dur, "motion_eof"))
    return out


def test_hysteresis_matches_loop(spark):
    rnd = random.Random(3)
    data = {}
    for k in range(25):
        v, x = [], 2.0
        for t in range(150):
            x = max(0.0, x + rnd.uniform(-1.2, 1.2))
            if rnd.random() > 0.05:
                v.append((t, x))
        data[f"v{k}"] = v
    df = spark.createDataFrame([(k, t, x) for k, v in data.items() for t, x in v], "vid string, t int, motion double")
    got = {k: [] for k in data}
    for r in S.hysteresis(df, "motion", 3.0, 1.2, 3, 12).collect():
        got[r.vid].append((r.start_s, r.end_s, r.source))
    for k, v in data.items():
        assert sorted(got[k]) == sorted(loop_hysteresis(v, v[-1][0] + 1, 3.0, 1.2, 3, 12))


def test_refractory_matches_loop(spark):
    rnd = random.Random(5)
    data = {f"v{k}": sorted({round(rnd.uniform(0, 60), 2) for _ in range(30)}) for k in range(10)}
    df = spark.createDataFrame([(k, t) for k, v in data.items() for t in v], "vid string, mid double")
    got = {k: [] for k in data}
    for r in S.refractory(df, 3.0).collect():
        got[r.vid].append(r.t)
    for k, v in data.items():
        want, last = [], -999.0
        for t in v:
            if t - last >= 3.0:
                want.append(t)
                last = t
        assert sorted(got[k]) == want


def test_densify_last_duplicate_wins(spark):
    df = spark.createDataFrame([("v", 0, 0.1, 1), ("v", 3, 0.2, 2), ("v", 3, 0.9, 3)], "vid string, t int, p double, o int")
    assert [r.p for r in S.densify(df, order="o").orderBy("t").collect()] == [0.1, 0.0, 0.0, 0.9]


def test_side_runs_restart_after_each_window(spark):
    rows = [("v", t, 1.0 if t < 12 else 0.0, "left" if t < 7 else "right") for t in range(14)]
    df = spark.createDataFrame(rows, "vid string, t int, celeb double, celeb_side string")
    out = sorted((r.start_s, r.end_s, r.celeb_side) for r in S.side_runs(df, 5, 2, 1).collect())
    assert out == [(0, 5, "left"), (5, 12, "right")]


def test_overlap_average_covers_everything(spark):
    df = spark.createDataFrame([("v", t, float(t)) for t in range(37)], "vid string, t int, p double")
    x = S.covering_starts(df, 8, 4)
    starts = sorted({r.seq_start for r in x.select("seq_start").collect()})
    assert starts == [0, 4, 8, 12, 16, 20, 24, 28, 29]
    out = S.overlap_average(x.withColumn("pred", F.col("p")))
    assert [r.p for r in out.orderBy("t").collect()] == [float(t) for t in range(37)]
