"""Interval algebra against loops, and invariants."""

import random

from pyspark.sql import functions as F

from spanforge.blocks import carry, merge_spans, point_join, span_join
from spanforge.operators import intervals as I


def segments(rnd, n, span=120):
    out = []
    for i in range(n):
        s = rnd.randint(0, span)
        out.append((s, s + rnd.randint(1, 25), rnd.choice(["A", "B"]), i))
    return out


def loop_merge(segs):
    out = []
    for s, e, c, _ in sorted(segs, key=lambda x: (x[0], x[1], x[3])):
        if not out:
            out.append([s, e, True, c])
            continue
        p = out[-1]
        if s >= p[1]:
            if s > p[1]:
                out.append([p[1], s, False, None])
            out.append([s, e, True, c])
        elif p[3] == c:
            p[1] = max(p[1], e)
        elif s > p[0]:
            p[1] = s
            out.append([s, e, True, c])
        else:
            out[-1] = [s, e, True, c]
    return [tuple(x) for x in out]


def loop_adjacent(segs, cap):
    out = []
    for s, e, th, c in segs:
        if out and out[-1][2:] == [th, c] and not (th and e - out[-1][0] > cap):
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e, th, c])
    return [tuple(x) for x in out]


def test_merge_and_adjacent_match_loops(spark):
    rnd = random.Random(1)
    data = {f"v{k}": segments(rnd, rnd.randint(1, 30)) for k in range(40)}
    df = spark.createDataFrame([(k, s, e, True, c, i) for k, v in data.items() for s, e, c, i in v], "vid string, start_s int, end_s int, threat boolean, color string, ord long")
    got = {k: [] for k in data}
    merged = I.merge_classified(df)
    for r in merged.collect():
        got[r.vid].append((r.start_s, r.end_s, r.threat, r.color))
    want = {k: loop_merge(v) for k, v in data.items()}
    for k in data:
        assert sorted(got[k], key=lambda x: x[:2]) == want[k]
    got = {k: [] for k in data}
    for r in I.merge_adjacent(merged, 40).collect():
        got[r.vid].append((r.start_s, r.end_s, r.threat, r.color))
    for k in data:
        assert sorted(got[k], key=lambda x: x[:2]) == loop_adjacent(want[k], 40)


def test_conflict_merge_loses_the_tail(spark):
    df = spark.createDataFrame([("v", 0, 100, True, "A", 0), ("v", 10, 20, True, "B", 1)], "vid string, start_s int, end_s int, threat boolean, color string, ord long")
    assert sorted((r.start_s, r.end_s, r.color) for r in I.merge_classified(df).collect()) == [(0, 10, "A"), (10, 20, "B")]


def test_cover_has_no_gaps(spark):
    rnd = random.Random(2)
    data = {f"v{k}": segments(rnd, rnd.randint(1, 12)) for k in range(20)}
    rows = [(k, s, e, True, c, i) for k, v in data.items() for s, e, c, i in v]
    df = spark.createDataFrame(rows, "vid string, start_s int, end_s int, threat boolean, color string, ord long")
    dur = spark.createDataFrame([(k, 130) for k in data] + [("empty", 50)], "vid string, dur int")
    got = {}
    for r in I.cover(I.merge_classified(df).withColumn("ord", F.lit(0)), dur).collect():
        got.setdefault(r.vid, []).append((r.start_s, r.end_s))
    assert got["empty"] == [(0, 50)]
    for k in data:
        x = sorted(got[k])
        assert x[0][0] == 0 and x[-1][1] == 130
        assert all(a[1] == b[0] for a, b in zip(x, x[1:]))


def test_carry_blocks_agree_with_plain(spark):
    rnd = random.Random(4)
    rows = [(f"v{i % 3}", i, rnd.choice([None, rnd.randint(0, 99)])) for i in range(300)]
    df = spark.createDataFrame(rows, "vid string, t int, x int")
    vals = {"mx": ("max", F.col("x")), "mn": ("min", F.col("x")), "sm": ("sum", F.coalesce("x", F.lit(0))), "la": ("last", F.col("x"))}
    for rev in (False, True):
        a = sorted(map(tuple, carry(df, ["vid"], "t", vals, reverse=rev).select("vid", "t", *vals).collect()))
        b = sorted(map(tuple, carry(df, ["vid"], "t", vals, block=13, reverse=rev).select("vid", "t", *vals).collect()))
        assert a == b


def test_range_joins_find_each_pair_once(spark):
    rnd = random.Random(6)
    L = [("v", i, rnd.randint(0, 80)) for i in range(40)]
    L = [(v, i, s, s + rnd.randint(0, 30)) for v, i, s in L]
    R = [(v, i + 100, s + 3, e + rnd.randint(0, 9)) for v, i, s, e in L[:25]]
    a = spark.createDataFrame(L, "vid string, a int, s int, e int")
    b = spark.createDataFrame(R, "vid string, b int, s2 int, e2 int")
    got = sorted((r.a, r.b) for r in span_join(a, b, ["vid"], ("s", "e"), ("s2", "e2"), block=7).collect())
    assert got == sorted((x[1], y[1]) for x in L for y in R if x[2] <= y[3] and y[2] <= x[3])
    pts = b.select("vid", "b", F.col("s2").alias("t"))
    got = sorted((r.a, r.b) for r in point_join(a, pts, ["vid"], ("s", "e"), "t", block=7).collect())
    assert got == sorted((x[1], y[1]) for x in L for y in R if x[2] <= y[2] <= x[3])


def test_merge_strictness(spark):
    df = spark.createDataFrame([("v", 0, 10), ("v", 10, 12), ("v", 20, 21)], "vid string, s int, e int")
    assert merge_spans(df, ["vid"], "s", "e").count() == 2
    assert merge_spans(df, ["vid"], "s", "e", 8, inclusive=False).count() == 2
    assert merge_spans(df, ["vid"], "s", "e", 9, inclusive=False).count() == 1


def test_confirm_and_trim(spark):
    win = spark.createDataFrame(
        [("v", 1, 0, 30, "motion_auto_close"), ("v", 2, 22, 40, "motion"), ("v", 3, 100, 130, "motion_auto_close"), ("v", 4, 200, 230, "motion_auto_close")],
        "vid string, win_id int, start_s int, end_s int, source string",
    )
    ev = spark.createDataFrame([("v", 203.5), ("v", 129.0)], "vid string, t double")
    assert sorted(r.win_id for r in I.confirm(win, ev).collect()) == [1, 2, 4]
    out = {r.win_id: r.end_s for r in I.trim_at_event(win, ev, 12).collect()}
    assert out == {1: 30, 2: 40, 3: 130, 4: 215}
