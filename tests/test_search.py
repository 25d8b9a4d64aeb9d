"""Nested selection and importances on planted data, designs against plain formulas."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stridewell.operators import designs as D
from stridewell.operators import models as L
from stridewell.operators import screening as C
from stridewell.operators import search as N
from stridewell.operators import wide as W


@pytest.fixture(scope="module")
def planted(spark):
    """Persons with two tasks; the label is the sign of ``good``; ``noise``, its ``echo`` and ``still`` say nothing. The
    echo gives the noise a component of its own."""
    rng = np.random.default_rng(5)
    rows = []
    for pid in range(120):
        for task in "AB":
            good, noise = float(rng.normal()), float(rng.normal())
            rows.append((pid, task, int(good > 0), 3 * good, noise, noise + 0.1 * float(rng.normal()), 1.0))
    return spark.createDataFrame(rows, "pid long, task string, y int, good double, noise double, echo double, still double")


def test_group_folds(planted):
    got = {r.pid: r.fold for r in N.group_folds(planted, 5).collect()}
    assert len(got) == 120 and set(got.values()) == set(range(5))
    sizes = np.bincount(list(got.values()))
    assert sizes.max() - sizes.min() <= 3
    labels = planted.groupBy("pid").agg(F.sum("y").alias("k")).collect()
    for k in (0, 1, 2):
        own = np.bincount([got[r.pid] for r in labels if r.k == k], minlength=5)
        assert own.max() - own.min() <= 1
    placed = N.with_folds(planted, 3, 2)
    for k in range(3):
        assert placed.filter((F.col("outer") == k) & F.col(f"inner_{k}").isNotNull()).count() == 0
        assert placed.filter((F.col("outer") != k) & F.col(f"inner_{k}").isNull()).count() == 0


@pytest.fixture(scope="module")
def search(planted):
    rows = N.with_folds(planted, 3, 2).cache()
    return N.Search(rows, ["good", "noise", "echo", "still"], [N.Trial(10.0, 0.1, 1.0), N.Trial(1e-6, 0.001, 0.5)], 3, 2), rows


def test_nested_selection_learns(search):
    found, _ = search
    table = {(r.outer, r.trial): r for r in found.trial_table().collect()}
    assert all(table[k, 0].chosen and not table[k, 1].chosen and table[k, 0].objective > table[k, 1].objective for k in range(3))
    assert min(r.balanced_accuracy for r in found.nested().collect()) > 0.85
    assert {(r.picked_by, r.trial) for r in found.final().collect()} == {(0, 0), (1, 0), (2, 0)}
    held = found.counts.filter((F.col("inner") == N.REFIT) & (F.col("trial") == 0)).agg(F.sum(F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp"))).first()[0]
    assert held == 240


def test_importance_finds_the_planted_feature(search):
    found, rows = search
    importance = found.component_importance(rows, 10)
    projected = N.back_project(importance, found.loadings())
    by_fold = {(r.outer, r.feature): r.importance for r in projected.collect()}
    assert all(by_fold[k, "good"] > by_fold[k, "noise"] and by_fold[k, "still"] == 0 for k in range(3))
    assert all(sum(by_fold[k, f] for f in ("good", "noise", "echo", "still")) == pytest.approx(1) for k in range(3))
    every = rows.sparkSession.createDataFrame([("good",), ("noise",), ("still",), ("absent",)], "feature string")
    summary = N.fold_summary(projected, every, 3).collect()
    assert [r.feature for r in summary][0] == "good" and len(summary) == 3
    assert N.fold_summary(projected, every).filter("feature = 'absent'").first().mean == 0


def test_importance_runs_one_python_a_task(search):
    """Rows were projected and classified in one stage, by two workers a task, and dealt rows were classified twice."""
    found, rows = search
    plan = found.component_importance(rows, 3)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInPandas classify") == 2 and "project(" not in plan


def test_tails_against_known_values():
    assert L.t_tail(2.228139, 10) == pytest.approx(0.05, abs=1e-6)
    assert L.f_tail(4.964603, 1, 10) == pytest.approx(0.05, abs=1e-6)
    assert L.chi2_tail(7.814728, 3) == pytest.approx(0.05, abs=1e-6)


def test_sphericity_and_contrasts(spark):
    rng = np.random.default_rng(8)
    a = rng.normal(size=(30, 3)) @ np.array([[1, 0.5, 0], [0, 1, 0.3], [0, 0, 2.0]])
    table = spark.createDataFrame([(i, f"a{k}", "b", float(a[i, k])) for i in range(30) for k in range(3)], "subject int, a string, b string, value double")
    s = np.cov(a.T)
    d = s - s.mean(0) - s.mean(1)[:, None] + s.mean()
    assert D.epsilon(table, ["a"]).first().eps == pytest.approx(np.trace(d) ** 2 / (2 * (d**2).sum()))
    trials = spark.createDataFrame([(i % 4, f, int(rng.random() < (0.9 if f == "hi" else 0.3))) for i in range(400) for f in ("hi", "lo")] + [(1, "few", 1)], "pid long, f string, correct int")
    got = {(r.x, r.y): r for r in D.contrast_table(trials, "f", fewest=500).collect()}
    assert set(got) == {("hi", "lo")} and got["hi", "lo"].significant and got["hi", "lo"].high < 0
    two = spark.createDataFrame([(k, "x", int(k >= 10)) for k in range(12)] + [(k, "y", 1) for k in range(12)], "subject int, condition string, x int")
    assert D.mcnemar_table(two).first().p == pytest.approx(L.chi2_tail(8.1, 1))


def test_mutual_information_of_a_known_class(spark):
    rows = [(v, "within", "A", "split", float(v), int(v >= 50)) for v in range(100)] + [(v, "within", "A", "none", float((v * 37) % 100), v % 2) for v in range(100)]
    table = spark.createDataFrame(rows, "pid long, variant string, task string, feature string, value double, y int")
    got = {r.feature: r.value for r in C.screen_mutual_information(table).collect()}
    assert got["split"] == pytest.approx(np.log(2), abs=0.05) and got["none"] < 0.1


def dense_fit(rows, people, x, precision):
    """Newton's method with every person a column."""
    z = np.concatenate([x, np.eye(people.max() + 1)[people]], 1)
    ridge = np.diag([0.0] * x.shape[1] + [precision] * (people.max() + 1))
    b = np.zeros(z.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-z @ b))
        h = (z * (p * (1 - p))[:, None]).T @ z + ridge
        b = b + np.linalg.solve(h, z.T @ (rows - p) - ridge @ b)
    return b[: x.shape[1]], np.sqrt(np.diag(np.linalg.inv(h)))[: x.shape[1]]


def logistic_trials(n, people, seed=4):
    rng = np.random.default_rng(seed)
    u = rng.normal(0, 1, people)
    pid, f, g = rng.integers(0, people, n), rng.integers(0, 3, n), rng.integers(0, 2, n)
    eta = 0.3 + u[pid] + np.array([0, 0.8, -0.5])[f] + np.array([0, 0.6])[g]
    return pid, f, g, (rng.random(n) < 1 / (1 + np.exp(-eta))).astype(int)


def test_logistic_equals_the_dense_fit(spark):
    pid, f, g, hit = logistic_trials(1500, 30)
    table = spark.createDataFrame(list(zip(pid.tolist(), [f"f{v}" for v in f], [f"g{v}" for v in g], hit.tolist(), strict=True)), "pid long, f string, g string, correct int")
    x = np.stack([np.ones(len(f)), f == 1, f == 2, g == 1], 1).astype(float)
    want, errors = dense_fit(hit, pid, x, 1.0)
    got = {r.term: r for r in D.logistic_table(table, "f", "g").collect()}
    names = ["intercept", "f f1", "f f2", "g g1"]
    assert [got[t].estimate for t in names] == pytest.approx(want.tolist(), abs=1e-7)
    assert [got[t].se for t in names] == pytest.approx(errors.tolist(), abs=1e-6)
    two = (f == 0) | (f == 2)
    want, errors = dense_fit(hit[two], np.unique(pid[two], return_inverse=True)[1], np.stack([np.ones(two.sum()), f[two] == 2, g[two] == 1], 1).astype(float), 1.0)
    pair = {(r.x, r.y): r for r in D.contrast_table(table, "f", "g").collect()}
    assert len(pair) == 3 and pair["f0", "f2"].estimate == pytest.approx(want[1], abs=1e-7) and pair["f0", "f2"].se == pytest.approx(errors[1], abs=1e-6)


def test_logistic_of_very_many_persons(spark):
    rows = spark.range(600_000).select((F.col("id") % 100_000).alias("pid"), F.when(F.rand(5) < 0.5, "a").otherwise("b").alias("f"), F.rand(6).alias("_r"), F.sin(F.col("id") % 100_000).alias("_u"))
    trials = rows.withColumn("correct", (F.col("_r") < 1 / (1 + F.exp(-(F.col("_u") + F.when(F.col("f") == "b", 1.0).otherwise(0.0))))).cast("int"))
    got = {r.term: r for r in D.logistic_table(trials, "f").collect()}
    assert got["f b"].low < 1.0 + 0.1 and got["f b"].high > 1.0 - 0.1 and got["f b"].se < 0.02


def test_components_of_a_known_table(spark):
    rng = np.random.default_rng(6)
    a = rng.normal(size=(200, 4)) @ np.array([[3, 1, 0, 0], [0, 2, 0, 0], [0, 0, 1, 0], [0, 0, 0.2, 0.5]])
    table = spark.createDataFrame([(k, *map(float, v)) for k, v in enumerate(a)], "pid long, a double, b double, c double, d double")
    got, k = L.principal_components(table, list("abcd"), 0.9)
    z = (a - a.mean(0)) / a.std(0)
    values, vectors = np.linalg.eigh(z.T @ z / len(z))
    shares = np.cumsum(values[::-1]) / values.sum()
    assert k == int(np.searchsorted(shares, 0.9)) + 1
    scores = np.array([[r[f"pc{i}"] for i in range(k)] for r in sorted(got.collect(), key=lambda r: r.pid)])
    assert np.allclose(np.abs(scores), np.abs(z @ vectors[:, ::-1][:, :k]), atol=1e-6)


def test_classifier_parts_planted_classes(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(300, 2))
    y = ((x**2).sum(1) > 1.4).astype(int)  # a ring: no straight line parts them
    table = spark.createDataFrame([(k, *map(float, v), int(c)) for k, (v, c) in enumerate(zip(x, y, strict=True))], "pid long, a double, b double, y int")
    mapped = L.fourier_features(table, ["a", "b"], 60, 0.5)
    told = L.classify(mapped.filter("pid < 200"), mapped.filter("pid >= 200"), [f"rf{k}" for k in range(60)]).collect()
    assert np.mean([r.y == r.yhat for r in told]) > 0.85


def wide_cells(spark, n=24, p=900, strides=(1, 9), seed=3):
    """Long cells of few rows and many columns; the label shows in stride 9 alone."""
    rng = np.random.default_rng(seed)
    out, matrices = [], {}
    y = rng.integers(0, 2, n // 2).repeat(2)
    for s in strides:
        x = rng.normal(size=(n, p))
        if s == 9:
            x[:, :60] += 2.5 * y[:, None]
        x[3, 5] = np.nan
        x[:, 7] = 1.0
        matrices[s] = x
        out += [(s, i // 2, "AB"[i % 2], int(y[i]), f"f{k}", None if np.isnan(x[i, k]) else float(x[i, k])) for i in range(n) for k in range(p)]
    return spark.createDataFrame(out, "stride int, pid long, task string, y int, feature string, value double"), matrices, y


def test_wide_components_equal_the_decomposition(spark):
    cells, matrices, _ = wide_cells(spark, strides=(1,))
    x = matrices[1]
    kept = np.nanstd(x, 0) ** 2 > 0.01
    z = np.nan_to_num((x - np.nanmean(x, 0)) / np.where(kept, np.nanstd(x, 0), 1)) * kept
    u, s, v = np.linalg.svd(z, full_matrices=False)
    scores, loaded = W.components(cells, 0.9)
    k = int(np.searchsorted(np.cumsum(s**2) / (s**2).sum(), 0.9)) + 1
    got = np.array([r.components for r in sorted(scores.collect(), key=lambda r: (r.pid, r.task))])
    assert got.shape == (24, k) and np.allclose(np.abs(got), np.abs(u * s)[:, :k], atol=1e-8)
    found = np.zeros((x.shape[1], k))
    for r in loaded.collect():
        found[int(r.feature[1:]), r.component] = r.loading
    assert np.allclose(np.abs(found), np.abs(v[:k].T), atol=1e-8) and np.allclose(z @ found, got, atol=1e-8)


def test_wide_search_picks_the_planted_stride(spark, tmp_path):
    cells, _, _ = wide_cells(spark, 40)
    cells.write.partitionBy("stride").parquet(str(tmp_path / "cells"))
    table = spark.read.parquet(str(tmp_path / "cells"))
    tried = [N.Trial(10.0, 0.001, 0.9, 1), N.Trial(10.0, 0.001, 0.9, 9)]
    search = W.WideSearch(table, tried, 3, 2)
    assert {r.stride for r in search.trial_table().filter("chosen").collect()} == {9}
    assert min(r.balanced_accuracy for r in search.nested().collect()) > 0.9
    projected = N.back_project(search.component_importance(repeats=10), search.loadings())
    top = {r.feature for r in projected.filter("outer = 0").orderBy(F.desc("importance")).limit(30).collect()}
    assert sum(int(f[1:]) < 60 for f in top) > 24
    with pytest.raises(ValueError, match="rows"):
        W.rows_of(spark.range(2000).select(F.col("id").alias("pid"), F.lit("A").alias("task"), F.lit(1).alias("y")), 0, 0)


def test_search_reads_its_strides_alone(spark, tmp_path, planted):
    other = planted.withColumn("good", F.rand(3)).withColumn("stride", F.lit(9)).unionByName(planted.withColumn("stride", F.lit(1))).unionByName(planted.withColumn("stride", F.lit(450)))
    N.with_folds(other, 3, 2).write.partitionBy("stride").parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows"))
    search = N.Search(rows, ["good", "noise", "echo"], [N.Trial(10.0, 0.1, 1.0, 9), N.Trial(10.0, 0.1, 1.0, 1)], 3, 2)
    assert {r.stride for r in search.trial_table().filter("chosen").collect()} == {1}
    plan = rows.filter(F.col("stride").isin([1, 9]))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [stride" in plan and "SelectedPartitions" not in plan or "PartitionFilters" in plan
    assert search.component_importance(rows, 5).count() > 0
