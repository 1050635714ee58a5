"""One-to-one matching against greedy loops, ties included."""

import random

from spanforge.operators import matching as M, records as R


def spans(rnd, n):
    out = []
    for _ in range(n):
        s = rnd.randint(0, 90)
        out.append((s, s + rnd.randint(2, 14)))
    return sorted(out)


def iou(a, b):
    i = max(0, min(a[1], b[1]) - max(a[0], b[0]))
    u = a[1] - a[0] + b[1] - b[0] - i
    return i / u if u else 0.0


def test_match_iou_equals_greedy(spark):
    rnd = random.Random(7)
    data = {k: (spans(rnd, rnd.randint(0, 14)), spans(rnd, rnd.randint(0, 14))) for k in range(60)}
    g = spark.createDataFrame([(k, i, s, e) for k, (a, _) in data.items() for i, (s, e) in enumerate(a)], "vid int, gt_id int, start_s int, end_s int")
    p = spark.createDataFrame([(k, i, s, e) for k, (_, b) in data.items() for i, (s, e) in enumerate(b)], "vid int, pred_id int, start_s int, end_s int")
    got = {k: set() for k in data}
    for r in M.match_iou(g, p, 0.3, block=9).collect():
        got[r.vid].add((r.gt_id, r.pred_id))
    for k, (a, b) in data.items():
        cand = sorted(((iou(x, y), i, j) for i, x in enumerate(a) for j, y in enumerate(b) if iou(x, y) >= 0.3), reverse=True)
        ug, up, want = set(), set(), set()
        for _, i, j in cand:
            if i not in ug and j not in up:
                ug.add(i), up.add(j), want.add((i, j))
        assert got[k] == want


def greedy(cand):
    """Pairs (order key, gt, pred) taken in order, each side once."""
    ug, up, want = set(), set(), set()
    for _, i, j in sorted(cand):
        if i not in ug and j not in up:
            ug.add(i), up.add(j), want.add((i, j))
    return want


def test_match_iou_in_a_dense_recording(spark):
    """100,000 windows of one recording that overlap in one chain, without gathering it."""
    rnd = random.Random(70)
    a, b = ([(s, s + rnd.randint(4, 20)) for s in (2 * k + rnd.randint(0, 3) for k in range(50_000))] for _ in range(2))
    g = spark.createDataFrame([(1, i, s, e) for i, (s, e) in enumerate(a)], "vid int, gt_id int, start_s int, end_s int")
    p = spark.createDataFrame([(1, i, s, e) for i, (s, e) in enumerate(b)], "vid int, pred_id int, start_s int, end_s int")
    cand = ((-iou(a[i], b[j]), -i, -j) for i in range(len(a)) for j in range(max(0, i - 14), min(len(b), i + 15)) if iou(a[i], b[j]) >= 0.3)
    got = M.match_iou(g, p, 0.3)
    assert "collect_list" not in got._jdf.queryExecution().toString()
    assert {(r.gt_id, r.pred_id) for r in got.collect()} == {(-i, -j) for i, j in greedy(cand)}


def test_match_tolerance_in_a_dense_recording(spark):
    rnd = random.Random(80)
    a, b = (sorted(rnd.randint(0, 200_000) / 4 for _ in range(20_000)) for _ in range(2))
    g = spark.createDataFrame([(1, i, t) for i, t in enumerate(a)], "vid int, gt_id int, t double")
    p = spark.createDataFrame([(1, i, t) for i, t in enumerate(b)], "vid int, pred_id int, t double")
    cand, lo = [], 0
    for i, t in enumerate(a):
        while lo < len(b) and b[lo] < t - 5:
            lo += 1
        j = lo
        while j < len(b) and b[j] <= t + 5:
            cand.append((abs(t - b[j]), i, j))
            j += 1
    assert {(r.gt_id, r.pred_id) for r in M.match_tolerance(g, p, 5.0).collect()} == greedy(cand)


def test_match_tolerance_equals_greedy(spark):
    rnd = random.Random(8)
    data = {k: (sorted(rnd.randint(0, 80) / 2 for _ in range(rnd.randint(0, 15))), sorted(rnd.randint(0, 80) / 2 for _ in range(rnd.randint(0, 15)))) for k in range(60)}
    g = spark.createDataFrame([(k, i, t) for k, (a, _) in data.items() for i, t in enumerate(a)], "vid int, gt_id int, t double")
    p = spark.createDataFrame([(k, i, t) for k, (_, b) in data.items() for i, t in enumerate(b)], "vid int, pred_id int, t double")
    got = {k: set() for k in data}
    for r in M.match_tolerance(g, p, 5.0, block=9).collect():
        got[r.vid].add((r.gt_id, r.pred_id))
    for k, (a, b) in data.items():
        ug, up, want = set(), set(), set()
        for _, i, j in sorted((abs(x - y), i, j) for i, x in enumerate(a) for j, y in enumerate(b) if abs(x - y) <= 5):
            if i not in ug and j not in up:
                ug.add(i), up.add(j), want.add((i, j))
        assert got[k] == want


def test_match_shots_equals_scan(spark):
    rnd = random.Random(9)
    data = {k: (spans(rnd, rnd.randint(0, 12)), sorted(float(rnd.randint(0, 110)) for _ in range(rnd.randint(1, 16)))) for k in range(50)}
    g = spark.createDataFrame([(k, i, s, e) for k, (a, _) in data.items() for i, (s, e) in enumerate(a)], "vid int, gt_id int, start_s int, end_s int")
    p = spark.createDataFrame([(k, i, t) for k, (_, b) in data.items() for i, t in enumerate(b)], "vid int, pred_id int, t double")
    got = {k: {} for k in data}
    for r in M.match_shots(p, g, 3.0).collect():
        got[r.vid][r.pred_id] = (r.gt_id, r.match_class)
    for k, (a, b) in data.items():
        free, want = list(range(len(a))), {}
        for j, t in enumerate(b):
            best, cls, bd = None, None, float("inf")
            for i in free:
                s, e = a[i]
                d = abs(t - (s + e) / 2)
                if s <= t <= e:
                    if d < bd:
                        best, cls, bd = i, "inside", d
                elif s - 3 <= t <= e + 3 and cls != "inside" and d < bd:
                    best, cls, bd = i, "tolerance", d
            if best is not None:
                free.remove(best)
            want[j] = (best, cls)
        assert got[k] == want


def test_nearest_at_any_distance(spark):
    rnd = random.Random(10)
    a, b = spans(rnd, 20), spans(rnd, 9)
    df = spark.createDataFrame([("v", i, s, e) for i, (s, e) in enumerate(a)] + [("w", 99, 0, 5)], "vid string, id int, start_s int, end_s int")
    pool = spark.createDataFrame([("v", i, s, e) for i, (s, e) in enumerate(b)], "vid string, k int, start_s int, end_s int")
    got = {r.id: r.near for r in M.nearest(df, pool, "k").collect()}
    assert got[99] is None
    mid = lambda x: (x[0] + x[1]) / 2
    for i, x in enumerate(a):
        j = min(range(len(b)), key=lambda j: (abs(mid(b[j]) - mid(x)), j))
        assert (got[i].idx, got[i].dist) == (j, abs(mid(b[j]) - mid(x)))


def test_reconcile_claims_best_overlap_once(spark):
    seg = spark.createDataFrame([("v", 1, 0, 20, True, 0), ("v", 2, 15, 40, True, 1), ("v", 3, 60, 70, True, 1), ("v", 4, 80, 90, False, 0)], "vid string, seg_id long, start_s int, end_s int, threat boolean, goals int")
    goals = spark.createDataFrame([("v", 1, 25.0, 14.0), ("v", 2, 12.0, 22.0), ("v", 3, 82.4, 85.2), ("v", 4, None, 5.0)], "vid string, goal_no long, start_time double, end_time double")
    s, g = R.reconcile(seg, goals)
    out = {r.seg_id: r for r in s.collect()}
    assert out[2].manually_verified and out[1].manually_verified and out[1].goals == 1
    assert out[3].goal_unconfirmed and not out[4].goal_unconfirmed
    assert (out[None].start_s, out[None].end_s, out[None].was_ai_detected) == (82, 86, False)
    assert {r.goal_no: r.was_ai_detected for r in g.collect()} == {1: True, 2: True, 3: False, 4: None}
