"""Resampling and order statistics against plain Python, also with one hot group."""

import datetime
import functools
import random
import statistics

import numpy as np
from pyspark.sql import functions as F

from spanforge import views as V
from spanforge.functions.selection import medians, selected
from spanforge.operators import attribution as A
from spanforge.plans import evaluation as E, reports as P


def test_parts_share_all_draws():
    """The parts' draws add up to n in every replicate, and look binomial."""
    n, size, reps = 10_007, 500, 400
    parts = -(-n // size)
    shares = np.array([P.drawn(k, parts, n, reps, 42, size) for k in range(parts)])
    assert (shares.sum(axis=0) == n).all()
    assert abs(shares[3].mean() - size) < 4 * (size / reps) ** 0.5
    assert 0.7 < shares[3].var() / (size * (1 - size / n)) < 1.4


def test_bootstrap_in_parts_of_text_ids(spark):
    rnd = random.Random(5)
    values = [rnd.gauss(10, 3) for _ in range(3000)]
    df = spark.createDataFrame([(f"id-{k}", v) for k, v in enumerate(values)], "vid string, v double")
    got = P.bootstrap_ci(df, "v", reps=400, size=256).first()
    half = 1.96 * statistics.stdev(values) / len(values) ** 0.5
    mean = statistics.fmean(values)
    assert abs(got["mean"] - mean) < 1e-9
    assert abs((mean - got.ci_lo) / half - 1) < 0.25 and abs((got.ci_hi - mean) / half - 1) < 0.25
    again = P.bootstrap_ci(df.repartition(7), "v", reps=400, size=256).first()
    assert np.allclose([*again], [*got])


def test_draws_do_not_depend_on_parts(spark):
    """Every replicate's mean is that of the positions its hashes name among all rows."""
    rnd, n, reps = random.Random(7), 1000, 20
    values = [None if k % 50 == 3 else rnd.gauss(10, 3) for k in range(n)]
    df = spark.createDataFrame(list(enumerate(values)), "vid long, v double")
    mix = lambda x: int(P.mix32(np.array([x & 0xFFFFFFFF], np.uint32))[0])
    want = []
    for rep in range(reps):
        start = mix(mix(mix(42) + rep))
        drawn = [values[mix(start + j * 0x9E3779B9) * n >> 32] for j in range(n)]
        want.append(statistics.fmean(v for v in drawn if v is not None))
    for size in (n, 64):
        got = {r.rep: r.v for r in P._draws(df, "v", reps, 42, "vid", size).collect()}
        assert np.allclose([got[r] for r in range(reps)], want, rtol=1e-12)


def test_bootstrap_of_a_million_rows_without_a_join(spark):
    df = spark.range(1_000_000).select(F.col("id").alias("vid"), (F.col("id") % 101).cast("double").alias("v"))
    means = P._draws(df, "v", 50, 42, "vid", P.PART)
    assert "Join" not in means._jdf.queryExecution().optimizedPlan().toString()
    got = [r.v for r in means.collect()]
    assert len(got) == 50 and abs(statistics.fmean(got) - 50) < 0.05 and 0.01 < statistics.stdev(got) < 0.06


def test_selection_refines_hot_groups(spark):
    rnd = random.Random(6)
    groups = {"hot": [rnd.gauss(0, 1) for _ in range(20_000)], "ties": [float(rnd.randint(0, 3)) for _ in range(5000)], "one": [7.0], "two": [1.0, 4.0], "same": [2.5] * 3000}
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs] + [("one", None)], "g string, v double")
    n = F.count("*")
    got = {r.g: (r.a, r.b, r.c) for r in selected(df, "v", ["g"], {"a": F.floor(n / 4), "b": n - 1, "c": n}, few=50).collect()}
    for g, vs in groups.items():
        s = sorted(vs)
        assert got[g] == (s[len(s) // 4], s[-1], None)
    assert {r.g: r.m for r in medians(df, "v", ["g"], "m", few=50).collect()} == {g: statistics.median(vs) for g, vs in groups.items()}
    whole = sorted(v for vs in groups.values() for v in vs)
    q = E.index_quantiles(df, "v").first()
    assert (q.n, q.min, q.p25, q["median"], q.p75, q.max) == (len(whole), whole[0], *[whole[len(whole) * k // 4] for k in (1, 2, 3)], whole[-1])
    by = {r.g: r["median"] for r in E.index_quantiles(df, "v", "g").collect()}
    assert by == {g: sorted(vs)[len(vs) // 2] for g, vs in groups.items()}
    plan = E.index_quantiles(df, "v", "g")._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Sort " not in plan


def test_selection_of_nothing(spark):
    empty = spark.createDataFrame([], "g string, v double")
    assert selected(empty, "v", ["g"], {"a": F.lit(0)}).count() == 0


def test_means_do_not_depend_on_the_order_of_rows(spark, tmp_path):
    """The same doubles from the same rows, so thresholds and roundings fall the same way."""
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    hours = [datetime.datetime(2024, 1, 1, h) for h in range(6)]
    rows = [(k, hours[k % 6], k % 4, "view", 0.1 * (k % 7 + 1), None) for k in range(60)]
    win = spark.createDataFrame([(0, 0, 1, 6), (0, 1, 2, 4)], "vid long, win_id long, start_s int, end_s int")
    got = []
    for name, order in (("up", 1), ("down", -1)):
        spark.createDataFrame(rows[::order], schema).coalesce(1).write.parquet(f"{tmp_path}/{name}/events.parquet")
        sig = V.sig(spark, f"{tmp_path}/{name}")
        got.append(sorted(map(tuple, sig.collect())))
        seconds = spark.createDataFrame([(0, t, 0.1 * (t + 1), 0.3 / (t + 1)) for t in range(6)][::order], "vid long, t int, motion_left double, motion_right double").coalesce(1)
        got[-1] += sorted(map(tuple, A.motion_side(win, seconds).collect()))
    assert got[0] == got[1]
    means = {t: m for _, t, m, *_ in got[0][:6]}
    assert means == {t: functools.reduce(lambda a, r: a + r[4], [r for r in rows if r[0] % 6 == t], 0.0) / 10 / 15 for t in range(6)}
