"""Block-parallel state machines against straight loops, also within one long stretch."""

import random
from itertools import groupby

from pyspark.sql import functions as F

from spanforge.machines import Chain, TwoThresholds
from spanforge.operators import intervals as I, series as S


def walked(machine, rows, block):
    state, out = machine.start, []
    for b, part in groupby(rows, key=lambda r: r[0] // block):
        part = list(part)
        out += machine.replay(part, list(state), b)
        state = machine.follow(machine.table(part), list(state), b)
    return out, list(state)


def windows(rows, open_at, stop_at, min_run, max_open):
    run, length, start, out = None, 0, None, []
    for t, m in rows:
        if m >= open_at:
            run, length = (t, 1) if run is None else (run, length + 1)
            if length >= min_run and start is None:
                start = run
        else:
            run, length = None, 0
        if start is not None and m < stop_at:
            out.append((start, t, "motion"))
            start = None
        if start is not None and t - start >= max_open:
            out.append((start, t, "motion_auto_close"))
            start, run, length = None, None, 0
    return out, start


def test_two_thresholds_by_blocks_of_any_size():
    rnd = random.Random(1)
    for _ in range(1500):
        block = rnd.choice([1, 2, 3, 5, 9, 50])
        limits = rnd.choice([1.0, 2.0]), rnd.choice([0.5, 1.0, 1.5, 2.5]), rnd.randint(1, 4), rnd.randint(1, 7)
        noise = rnd.random()
        rows = [(t, rnd.choice([0.2, 0.7, 1.2, 1.7, 2.2, 3.0]) if rnd.random() < noise else 2.2) for t in sorted(rnd.sample(range(80), rnd.randint(1, 70)))]
        want, still = windows(rows, *limits)
        got, state = walked(TwoThresholds(*limits, block), rows, block)
        assert got == want
        assert (state[1] if state and state[0] == 0 else None) == still


def test_chain_by_blocks_of_any_size():
    rnd = random.Random(2)
    for _ in range(1500):
        block, gap, strict = rnd.choice([1, 2, 3, 5, 9, 50]), rnd.randint(0, 9), rnd.random() < 0.5
        rows = sorted((a, a + rnd.randint(0, 12)) for a in (rnd.randint(0, 60) for _ in range(rnd.randint(1, 40))))
        base, want = None, []
        for a, b in rows:
            head = base is None or (b - base > gap if strict else b - base >= gap)
            base = a if head else base
            want.append(head)
        got, _ = walked(Chain(gap, strict, ""), [(a, b, a) for a, b in rows], block)
        assert [r[-1] for r in got] == want
        assert len({r[-3:-1] for r in got}) == sum(want)


def test_hysteresis_in_one_stretch_of_a_million_seconds(spark):
    n = 1_000_000
    x = spark.range(n).select(F.lit("v").alias("vid"), F.col("id").cast("int").alias("t"), F.when(F.col("id") % 997 < 3, 2.0).otherwise(5.0).alias("motion"))
    got = S.hysteresis(x)
    assert "collect_list" not in got._jdf.queryExecution().toString()
    want, still = windows([(t, 2.0 if t % 997 < 3 else 5.0) for t in range(n)], 3.0, 1.2, 8, 30)
    want += [(still, n, "motion_eof")] if still is not None else []
    assert sorted(map(tuple, got.select("start_s", "end_s", "source").collect())) == sorted(want)


def test_refractory_in_a_dense_recording(spark):
    rnd = random.Random(3)
    times = sorted({rnd.randint(0, 2_000_000) / 8 for _ in range(100_000)})
    want, last = [], None
    for t in times:
        if last is None or t - last >= 3.0:
            want.append(t)
            last = t
    got = S.refractory(spark.createDataFrame([("v", t) for t in times], "vid string, mid double"), 3.0)
    assert sorted(r.t for r in got.collect()) == want


def test_merge_adjacent_in_one_long_run(spark):
    rnd = random.Random(4)
    rows = sorted((s, s + rnd.randint(1, 90)) for s in (rnd.randint(0, 400_000) for _ in range(60_000)))
    rows = [(s, e, True, None) for s, e in rows] + [(500_000 + k, 500_002 + k, False, "White") for k in range(1000)]
    want: list[list] = []
    for s, e, threat, color in rows:
        if want and want[-1][2:] == [threat, color] and not (threat and e - want[-1][0] > 60):
            want[-1][1] = max(want[-1][1], e)
        else:
            want.append([s, e, threat, color])
    got = I.merge_adjacent(spark.createDataFrame([("v", *r) for r in rows], "vid string, start_s int, end_s int, threat boolean, color string"), 60)
    key = lambda r: (r[0], r[1])
    assert sorted(([r.start_s, r.end_s, r.threat, r.color] for r in got.collect()), key=key) == sorted(want, key=key)
