"""Recordings end to end: the chain against plain Python, nested segments, pairs, time that grows with the rows alone."""

import bisect
import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from stridewell.operators import bundles as B
from stridewell.operators import motion as M
from stridewell.operators import resample as R
from stridewell.operators import segments as G

KEY = ["pid"]


def sessions():
    """Two sessions that start at 1000 and later, with gaps, a repeated time and times that are equal once rounded."""
    rng = random.Random(4)
    rows = []
    for pid in (1, 2):
        t, idx = 1000.0 + 37 * pid, 0
        for _ in range(120):
            rows.append((pid, idx, t, rng.uniform(-3, 3), 1.0 if idx == 7 * pid else 0.0))
            idx += 1
            if idx == 40:
                rows.append((pid, idx, t, 99.0, 0.0))
                idx += 1
            t += rng.choice([0.01, 0.01, 0.01, 0.0104, 0.05])
    return rows


def plain_chain(rows, step, shift):
    """Row by row: truncate, first of each time, grid, join by equal rounded times, fill, round, drop, velocity."""
    pressed = [k for k, r in enumerate(rows) if r[4] > 0]
    seen, kept = set(), []
    for r in rows[pressed[0] :]:
        if r[2] not in seen:
            seen.add(r[2])
            kept.append(r)
    times = [r[2] for r in kept]
    n = math.ceil((times[-1] - times[0]) / step - 1e-9) + 1
    by_time: dict = {}
    for r in kept:
        by_time.setdefault(round(r[2] * 1000), []).append(r[3])
    joined = []
    for k in range(n):
        whole = round((times[0] + k * step) * 1000)
        joined += [(whole / 1000, x) for x in by_time.get(whole, [None])]
    known = [i for i, (_, x) in enumerate(joined) if x is not None]
    filled = []
    for i, (t, x) in enumerate(joined):
        at = bisect.bisect_left(known, i)
        if x is None and 0 < at < len(known):
            a, b = known[at - 1], known[at]
            x = joined[a][1] + (joined[b][1] - joined[a][1]) * (i - a) / (b - a)
        if x is not None:
            filled.append((t, round(x, 6)))
    if len(filled) < 2 * shift or any(b[0] <= a[0] for a, b in zip(filled, filled[1:], strict=False)):
        return [], len(filled)
    out = []
    for i, (t, x) in enumerate(filled):
        a, b = (i, i + shift) if i < shift else (i - shift, i) if i >= len(filled) - shift else (i - shift, i + shift)
        out.append((i, t, x, (filled[b][1] - filled[a][1]) / (filled[b][0] - filled[a][0])))
    return out, len(filled)


@pytest.mark.parametrize("rows_of_a_chunk", [65_536, 5])
def test_chain_equals_plain_python(spark, monkeypatch, rows_of_a_chunk):
    monkeypatch.setattr(R, "CHUNK_ROWS", rows_of_a_chunk)
    rows, step = sessions(), 0.01
    df = spark.createDataFrame(rows, "pid long, idx long, t double, x double, pressed double")
    started = R.truncate_start(df, KEY, F.col("pressed") > 0)
    assert {r.i for r in started.groupBy("pid").agg(F.min("idx").alias("i")).collect()} == {0}
    whole = R.resampled(R.dedup_time(started, KEY), KEY, step, ("x",))
    kept, rejects = M.checked(whole, KEY, 2)
    got = {}
    for r in M.velocity(kept, KEY, "x", 2).collect():
        got.setdefault(r.pid, []).append((r.idx, r.t, r.x, r.v))
    refused = {r.pid: (r.reason, r.n) for r in rejects.collect()}
    for pid in (1, 2):
        want, n = plain_chain([r for r in rows if r[0] == pid], step, 2)
        if want:
            own = sorted(got[pid])
            assert [(a[0], round(a[1], 6)) for a in own] == [(a[0], round(a[1], 6)) for a in want]
            assert np.allclose([a[2:] for a in own], [a[2:] for a in want], rtol=1e-7, atol=2e-6)
        else:
            assert refused[pid] == ("repeated time", n) and pid not in got


def test_rejects_by_reason(spark):
    make = lambda pid, n, step=0.1, w=1.0: [(pid, k, k * step, float(k), 0.0, 0.0, 0.0, w) for k in range(n)]
    rows = make(1, 3) + make(2, 4) + make(3, 9, 0.0) + make(4, 9, 0.1, 0.0) + make(5, 9)
    df = spark.createDataFrame(rows, "pid long, idx long, t double, x double, qx double, qy double, qz double, qw double")
    kept, rejects = M.checked(df, KEY, 2, rotation=True)
    assert {(r.pid, r.reason, r.n) for r in rejects.collect()} == {(1, "too short", 3), (3, "repeated time", 9), (4, "zero quaternion", 9)}
    assert {r.pid for r in kept.select("pid").distinct().collect()} == {2, 5}
    # Exactly 2 * shift samples give rows.
    assert M.velocity(df.filter("pid = 2"), KEY, "x", 2).count() == 4 and M.angular_velocity(df.filter("pid = 2"), KEY, 2).count() == 4


def plain_acceleration(x, t, shift, stride):
    n, acc = len(x), {}

    def stencil(a, b, c):
        d1, d2 = t[b] - t[a], t[c] - t[b]
        return 2 * (x[a] * d2 - x[b] * (d1 + d2) + x[c] * d1) / (d1 * d2 * (d1 + d2))

    def fill(start, end, value):
        for k in range(start, end, stride):
            v = value(k)
            acc.update({j: v for j in range(k, min(k + stride, end))})

    fill(shift, n - shift, lambda k: stencil(k - shift, k, k + shift))
    fill(0, shift, lambda k: stencil(k, k + shift, k + 2 * shift) if k + 2 * shift < n else acc[k - 1] if k else 0.0)
    fill(n - shift, n, lambda k: stencil(k - 2 * shift, k - shift, k) if k - 2 * shift >= 0 else acc[k - 1])
    return [acc[k] for k in range(n)]


@pytest.mark.parametrize("n, shift, stride", [(20, 2, 1), (20, 3, 2), (20, 3, 7), (7, 3, 1), (8, 3, 2), (9, 4, 1), (9, 4, 3), (5, 4, 2), (6, 3, 1)])
def test_acceleration_repeats_its_neighbour(spark, n, shift, stride):
    rng = random.Random(n * shift)
    x, t = [rng.uniform(-2, 2) for _ in range(n)], np.cumsum([rng.uniform(0.1, 0.3) for _ in range(n)]).tolist()
    df = spark.createDataFrame([(1, k, t[k], x[k]) for k in range(n)], "pid long, idx long, t double, x double")
    got = [r.a for r in sorted(M.acceleration(df, KEY, "x", shift, stride=stride).collect(), key=lambda r: r.idx)]
    assert got == pytest.approx(plain_acceleration(x, t, shift, stride))


def test_smoothing_far_into_a_session(spark):
    """A quadratic has the same second derivative at any place: no digits are lost at a million samples."""
    df = spark.range(1_000_000, 1_000_060).select(F.lit(1).alias("pid"), F.col("id").alias("idx"), (F.col("id") / 90.0).alias("t"), (F.sin(F.col("id") * 0.01) * 1e-3).alias("x"))
    far = df.withColumn("_k", F.col("idx") - 1_000_000)
    # Rows around the middle of a session that long: the window's count says how many follow.
    near = far.withColumn("idx", F.col("_k"))
    a = {r._k: r.sg for r in M.savitzky_golay(near, KEY, "x", deriv=2, per_time=False).collect()}
    x = {k: math.sin((1_000_000 + k) * 0.01) * 1e-3 for k in range(60)}
    fit = lambda k: 2 * sum(w * x[k + j] for w, j in zip((2, -1, -2, -1, 2), range(-2, 3), strict=True)) / 14
    assert all(abs(a[k] - fit(k)) < 1e-12 for k in range(2, 58))
    shifted = df.withColumn("n", F.lit(0))
    b = M.savitzky_golay(shifted.unionByName(spark.range(1_000_000).select(F.lit(1).alias("pid"), F.col("id").alias("idx"), (F.col("id") / 90.0).alias("t"), F.lit(0.0).alias("x"), F.lit(0).alias("n"))), KEY, "x", deriv=2, per_time=False)
    far_rows = {r.idx - 1_000_000: r.sg for r in b.filter("idx >= 1000002 AND idx < 1000058").collect()}
    assert len(far_rows) == 56 and all(abs(far_rows[k] - fit(k)) < 1e-9 for k in far_rows)


def turned(spark, n, seed=1):
    rng = np.random.default_rng(seed)
    q = rng.normal(size=(n, 4))
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    rows = [(1 + (k >= n - 3), k, *map(float, v)) for k, v in enumerate(q)]
    return spark.createDataFrame(rows, "pid long, idx long, qx double, qy double, qz double, qw double"), q


def test_pairs_of_a_whole_segment(spark):
    df, q = turned(spark, 2003)
    angle = 2 * np.arccos(np.minimum(1, np.abs(q[:2000] @ q[:2000].T)))[np.triu_indices(2000, 1)]
    got = {r.pid: r for r in M.pair_dispersion(df, KEY).collect()}
    assert got[1].n_pairs == 2000 * 1999 // 2 and got[1].value == pytest.approx(angle.mean(), rel=1e-9) and got[2].n_pairs == 3
    small, q = turned(spark, 43)
    pairs = {(r.i, r.j): r.angle for r in M.sample_pairs(small, KEY, block=7).filter("pid = 1").collect()}
    assert len(pairs) == 40 * 39 // 2 and all(a == pytest.approx(2 * math.acos(min(1, abs(float(q[i] @ q[j])))), abs=1e-6) for (i, j), a in pairs.items())


def test_nearest_and_intervals_over_chunks(spark):
    rng = random.Random(8)
    times = sorted(round(rng.uniform(1000, 1100), 1) for _ in range(300))
    samples = spark.createDataFrame([(1, k, t) for k, t in enumerate(times)], "pid long, idx long, t double")
    events = [990.0, 1000.05, 1050.0, 1050.05, 1099.9, 1200.0]
    log = spark.createDataFrame([(1, e, k) for k, e in enumerate(events)], "pid long, event_t double, step long")
    for span in (0.5, 13.0, 1e6):
        got = {r.step: r.idx for r in G.nearest(log, samples, KEY, span).collect()}
        assert got == {k: min(range(300), key=lambda i: (round(abs(times[i] - e), 9), i)) for k, e in enumerate(events)}


def plain_slices(times, log):
    """Step and substep slices of a log (step, kind, t) by nearest places, as loops over the steps."""
    near = lambda of, t: min(range(len(of)), key=lambda k: (abs(of[k] - t), k))
    found, steps = [], sorted({s for s, _, _ in log})
    for s in steps:
        rows = [r for r in log if r[0] == s]
        before = [r for r in log if r[0] == s - 1]
        a = near(times, min(times) if not before else max(r[2] for r in before))
        b = near(times, max(r[2] for r in rows))
        inside = times[a:b]
        for k, (_, kind, t) in enumerate(rows):
            start = min(times) if s == 0 and k == 0 else max(r[2] for r in before) if k == 0 else rows[k - 1][2]
            lo, hi = (a + near(inside, start), a + near(inside, t)) if inside else (a, a)
            found.append((s, k, len(found), len(rows) * s + k, kind, a, b, lo, hi))
    return found


def test_nested_segments(spark):
    """Unequal substeps, an event between two samples, one that ties, a step without samples, an unknown type."""
    rng = random.Random(5)
    times = [1000 + 0.5 * k for k in range(80)]
    log = [(0, "AttachPiece", 1004.25), (0, "InsertScrew", 1009.1), (1, "AttachPiece", 1013.0), (2, "UseKey", 1013.1), (3, "AttachPiece", 1020.0), (3, "InsertScrew", 1022.75), (3, "UseKey", 1031.3), (4, "InsertScrew", 1036.0)]
    samples = spark.createDataFrame([(1, k, t, rng.uniform(0, 9)) for k, t in enumerate(times)], "pid long, idx long, t double, x double")
    rows = spark.createDataFrame([(1, s, k, t, n) for n, (s, k, t) in enumerate(log)], "pid long, step long, kind string, event_t double, row long")
    for span in (3.0, 1e6):
        got = sorted(tuple(r) for r in G.nested(rows, samples, KEY, span).select("step", "sub", "sub_id", "ref_id", "kind", "step_start", "step_end", "start_idx", "end_idx").collect())
        assert got == sorted(plain_slices(times, log))
    assert len({r[3] for r in got}) < len(got) and len({r[2] for r in got}) == len(got)  # numbers by the own step's rows name two alike
    codes = rows.select(G.type_code(F.col("kind"), ("AttachPiece", "InsertScrew", "UseKey")).alias("c"))
    assert sorted(r.c for r in codes.collect()) == [0, 0, 0, 1, 1, 1, 2, 2]
    with pytest.raises(Exception, match="unknown type"):
        rows.select(G.type_code(F.col("kind"), ("AttachPiece", "UseKey"))).collect()
    table = {(r.part, r.stat): r.value for r in B.duration_table(rows, samples, KEY).collect()}
    spans = {i: times[hi - 1] - times[lo] for _, _, i, _, _, _, _, lo, hi in plain_slices(times, log) if hi > lo}
    assert table["substep", "longest"] == max(spans, key=lambda i: (spans[i], -i)) and table["substep", "mean"] == pytest.approx(np.mean(list(spans.values())))
    assert table["tail", "duration"] == times[-1] - 1036.0


@pytest.mark.parametrize("name", ["interpolate", "nearest"])
def test_time_grows_with_the_rows(spark, name):
    def run(n):
        rec = spark.range(n).select(F.lit(1).alias("pid"), F.col("id").alias("idx"), F.col("id").alias("k"), (F.col("id") / 90.0).alias("t"), F.when(F.col("id") % 10 == 0, F.rand(3)).alias("x"))
        log = spark.range(n // 100).select(F.lit(1).alias("pid"), F.col("id").alias("step"), (F.col("id") * 1.1).alias("event_t"))
        began = time.time()
        made = R.interpolate(rec, KEY) if name == "interpolate" else G.nearest(log, rec, KEY)
        made.write.format("noop").mode("overwrite").save()
        return time.time() - began

    run(1000)
    few, many = run(10_000), run(40_000)
    assert many < 10 and many < 4.5 * few + 1


def test_columns_are_filled_in_one_pass(spark):
    """Ten columns with gaps of their own, over chunks that cut the gaps: each as a plain loop fills it, and the plan reads
    its table no oftener than for one column."""
    rng, n = random.Random(5), 400
    columns = tuple(f"c{i}" for i in range(10))
    rows = [(p, k, *(rng.random() if rng.random() < 0.3 else None for _ in columns)) for p in (1, None) for k in range(n)]
    schema = "pid long, k long, " + ", ".join(f"{c} double" for c in columns)
    found = R.interpolate(spark.createDataFrame(rows, schema), ["pid"], columns)
    got = {(r.pid, r.k): r for r in found.collect()}
    assert len(got) == len(rows)
    for p in (1, None):
        own = [r for r in rows if r[0] == p]
        for i, c in enumerate(columns, 2):
            known = [r[1] for r in own if r[i] is not None]
            for r in own:
                a, b = max((k for k in known if k <= r[1]), default=None), min((k for k in known if k >= r[1]), default=None)
                value = getattr(got[p, r[1]], c)
                if a is None or b is None:
                    assert value is None
                else:
                    want = own[a][i] if a == b else own[a][i] + (own[b][i] - own[a][i]) * (r[1] - a) / (b - a)
                    assert value == pytest.approx(want, abs=1e-12)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Relation [") <= 2
