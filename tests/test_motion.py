"""Closed-form properties of the derivatives."""

import math

import pytest
from pyspark.sql import functions as F

from stridewell.operators import evaluation as E
from stridewell.operators import motion as M


def line(spark, n=20):
    return spark.range(n).select(F.lit(1).alias("pid"), F.col("id").alias("idx"), (F.col("id") * 0.5).alias("t"), (F.col("id") * 1.5).alias("x"))


def test_constant_velocity(spark):
    assert {round(r.v, 9) for r in M.velocity(line(spark), ["pid"], shift=2).collect()} == {3.0}
    assert {round(abs(r.a), 9) for r in M.acceleration(line(spark), ["pid"], shift=2).collect()} == {0.0}
    assert any(abs(r.a) > 1 for r in M.acceleration(line(spark), ["pid"], shift=2, compat=True).collect())


def test_constant_acceleration(spark):
    df = line(spark).withColumn("x", F.col("t") * F.col("t"))
    assert {round(r.a, 9) for r in M.acceleration(df, ["pid"]).collect()} == {2.0}
    # Per sample the second derivative is 2 dt^2 = 0.5; it is divided by the time step once.
    assert {round(r.sg, 9) for r in M.savitzky_golay(df, ["pid"], deriv=2, per_time=False).collect()} == {0.5}
    assert {round(r.sg, 9) for r in M.savitzky_golay(df, ["pid"], deriv=2).collect()} == {1.0}
    assert {round(r.sg - 2 * r.t, 9) for r in M.savitzky_golay(df, ["pid"]).collect()} == {0.0}


def test_short_sessions_have_no_rows(spark):
    assert M.velocity(line(spark, 3), ["pid"], shift=2).count() == 0 and M.velocity(line(spark, 4), ["pid"], shift=2).count() == 4
    assert M.acceleration(line(spark, 0), ["pid"]).count() == 0


def test_constant_rotation(spark):
    half = F.col("t") * 0.4 / 2
    df = line(spark).select("pid", "idx", "t", F.lit(0.0).alias("qx"), F.lit(0.0).alias("qy"), F.sin(half).alias("qz"), F.cos(half).alias("qw"))
    assert {round(r.wz, 9) for r in M.angular_velocity(df, ["pid"]).collect()} == {0.4}


def test_hull_of_a_cube():
    import numpy as np

    corners = np.array([[x, y, z] for x in (0, 2) for y in (0, 2) for z in (0, 2)] + [[1, 1, 1]], float)
    assert M.convex_volume(corners) == pytest.approx(8.0)
    assert M.convex_volume(corners[:3]) is None
    assert M.convex_volume(corners * [1, 1, 0]) is None


def test_holm(spark):
    p = spark.createDataFrame([(1, 0.01), (1, 0.04), (1, 0.03), (1, 0.005)], "g int, p double")
    assert sorted(round(r.p_holm, 6) for r in E.holm(p, ["g"]).collect()) == [0.02, 0.03, 0.06, 0.06]


def test_metrics_without_positives(spark):
    counts = spark.createDataFrame([(1, 5, 0, 0, 0)], "k int, tn long, fp long, fn long, tp long")
    r = E.metrics(counts, ["k"]).first()
    assert (r.accuracy, r.mcc, r.sensitivity) == (1.0, 0.0, 0.0) and math.isclose(r.f1, 1.0)


def turning(spark, degrees):
    """Rotation about z by the given angles."""
    rows = [(1, k, k * 0.1, 0.0, 0.0, math.sin(math.radians(a) / 2), math.cos(math.radians(a) / 2)) for k, a in enumerate(degrees)]
    return spark.createDataFrame(rows, "pid long, idx long, t double, qx double, qy double, qz double, qw double")


def test_smoothed_rate_of_a_parabola(spark):
    got = sorted((r.idx, r.sz) for r in M.smoothed_rate(turning(spark, [0.5 * k * k for k in range(12)]), ["pid"]).collect())
    # Rates rise by one degree a sample, 0.1 seconds long: the slope is the same everywhere, also in row 0.
    assert [k for k, _ in got] == list(range(12)) and {round(v, 9) for _, v in got} == {round(math.radians(1) / 0.1, 9)}


def test_adaptive_filter_gain(spark):
    angle = lambda r: math.degrees(2 * math.atan2(r.sz, r.sw))
    run = lambda *degrees: [round(angle(r), 6) for r in sorted(M.adaptive_filter(turning(spark, degrees), ["pid"]).collect(), key=lambda r: r.idx)]
    # Turns as small as these go along the chord, which is not the arc to the last digit.
    assert run(0, 0.4) == pytest.approx([0, 0.4 * 0.05], abs=1e-4)
    assert run(0, 20) == pytest.approx([0, 10.0], abs=1e-6)
    middle = 0.05 + 0.45 * (2.75 - 0.5) / 4.5
    assert run(0, 2.75) == pytest.approx([0, 2.75 * middle], abs=1e-3)
    zero = turning(spark, [3, 3]).withColumn("qz", F.when(F.col("idx") == 1, 0.0).otherwise(F.col("qz"))).withColumn("qw", F.when(F.col("idx") == 1, 0.0).otherwise(F.col("qw")))
    assert [round(angle(r), 6) for r in M.adaptive_filter(zero, ["pid"]).collect()] == [3.0, 3.0]


def test_hull_from_parts(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    points = [(k % 2, *map(float, rng.normal(size=3))) for k in range(400)]
    table = spark.createDataFrame(points, "pid long, px double, py double, pz double").repartition(5)
    got = {r.pid: r.value for r in M.hull_volume(table, ["pid"]).collect()}
    for pid in (0, 1):
        assert got[pid] == pytest.approx(M.convex_volume(np.array([p[1:] for p in points if p[0] == pid])))
