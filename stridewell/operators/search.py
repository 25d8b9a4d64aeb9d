"""Nested selection of a classifier's parameters, all folds and trials at once, and the importance of features.

A trial is a share of variance kept by the components, a width (gamma) of random Fourier features and a penalty; the
classifier is a class-balanced least-squares one on those features. Every fit needs only sums over its training rows:
one pass gives the moments of all folds, a second one the sums of all folds and trials, a third one the counts of hits
on held-out rows. What reaches the driver is of the size folds x trials x features^2, never of the rows'.

Rows: pid, task, y (0 or 1) and number columns without nulls; a person's rows are all in one fold. With a column ``stride`` each
row stands once for every stride and a trial learns from the rows of its own. ``wide.WideSearch`` does the same for tables
with more columns than rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from operator import or_

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import staged
from .evaluation import harmonic, metrics

#: Rows of a stratum that are numbered in one task.
BLOCK = 100_000
#: Columns that vary less in the rows to learn from are left out.
LEAST_VARIANCE = 0.01
#: Of a refit on all rows that an outer fold learns from, in the place of the inner fold.
REFIT = -1


def group_folds(rows: DataFrame, folds: int, seed: int = 42, out: str = "fold") -> DataFrame:
    """pid, fold: persons with equal label counts are a stratum and are dealt in the order of a hash, each stratum
    starting at another fold, so folds are alike in size and labels."""
    people = rows.groupBy("pid").agg(F.count_if(F.col("y") == 0).alias("_n0"), F.count_if(F.col("y") == 1).alias("_n1"))
    size = people.groupBy(F.col("_n0").alias("_s0"), F.col("_n1").alias("_s1")).agg(F.count("*").alias("_size"))
    order = F.md5(F.concat_ws("-", F.lit(str(seed)), F.col("pid").cast("string")).cast("binary"))
    placed = people.join(size, (F.col("_n0") == F.col("_s0")) & (F.col("_n1") == F.col("_s1"))).withColumn("_order", order)
    placed = placed.withColumn("_block", F.pmod(F.xxhash64("_order"), F.ceil(F.col("_size") / BLOCK)))
    own = Window.partitionBy("_n0", "_n1", "_block").orderBy("_order")
    return placed.select("pid", F.pmod(F.row_number().over(own) - 1 + F.col("_n0") + 2 * F.col("_n1"), F.lit(folds)).cast("int").alias(out))


def with_folds(rows: DataFrame, outer: int = 5, inner: int = 4, seed: int = 42) -> DataFrame:
    """rows with ``outer`` and, for each outer fold k, ``inner_k`` of the persons that it learns from (else null)."""
    placed = rows.join(group_folds(rows, outer, seed, "outer"), "pid")
    for k in range(outer):
        placed = placed.join(group_folds(placed.filter(F.col("outer") != k), inner, seed + 1 + k, f"inner_{k}"), "pid", "left")
    return placed


@dataclass(frozen=True)
class Trial:
    penalty: float
    gamma: float
    share: float
    stride: int = 1


def trials(n: int, seed: int = 42, strides: tuple[int, ...] = (1,)) -> list[Trial]:
    """Penalty and gamma log-uniform in [0.01, 100] and [0.001, 0.1], share uniform in [0.5, 1], stride one of those given."""
    rng = np.random.default_rng(seed)
    return [Trial(float(10 ** rng.uniform(-2, 2)), float(10 ** rng.uniform(-3, -1)), float(rng.uniform(0.5, 1)), int(strides[rng.integers(len(strides))])) for _ in range(n)]


class Model:
    """Standardisation, components and weights of one fit; ``w`` is null until it is solved."""

    def __init__(self, n: np.ndarray, sums: np.ndarray, products: np.ndarray, trial: Trial, features: int, seed: int):
        total = max(n.sum(), 1)
        self.mean = sums / total
        spread = products / total - np.outer(self.mean, self.mean)
        sd = np.sqrt(np.maximum(np.diag(spread), 0))
        self.kept = sd * sd > LEAST_VARIANCE
        self.sd = np.where(self.kept, sd, 1.0)
        values, vectors = np.linalg.eigh(spread / np.outer(self.sd, self.sd) * np.outer(self.kept, self.kept))
        values, vectors = np.maximum(values[::-1], 0), vectors[:, ::-1]
        shares = np.cumsum(values) / (values.sum() or 1.0)
        k = min(len(values), int(np.searchsorted(shares, trial.share - 1e-12)) + 1)
        # A vector's largest part is positive, so signs do not depend on the solver.
        signs = np.sign(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])])
        self.loadings = (vectors * signs)[:, :k]
        rng = np.random.default_rng(seed)
        self.turns, self.offsets = rng.normal(0, math.sqrt(2 * trial.gamma), (k, features)), rng.uniform(0, 2 * math.pi, features)
        self.weight = np.where(n > 0, total / (2 * np.maximum(n, 1)), 0.0)
        self.penalty, self.w = trial.penalty, None

    def components(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.sd * self.kept) @ self.loadings

    def mapped(self, components: np.ndarray) -> np.ndarray:
        z = np.cos(components @ self.turns + self.offsets) * math.sqrt(2 / len(self.offsets))
        return np.concatenate((z, np.ones((len(z), 1))), axis=1)

    def solve(self, gram: np.ndarray, target: np.ndarray) -> None:
        keep = np.eye(len(gram)) / self.penalty
        keep[-1, -1] = 1e-9
        self.w = np.linalg.solve(gram + keep, target)

    def classes(self, components: np.ndarray) -> np.ndarray:
        return (self.mapped(components) @ self.w > 0).astype(int)


def summed(rows: DataFrame, cells: Callable[[pd.DataFrame], dict[tuple[int, ...], np.ndarray]]) -> dict[tuple[int, ...], np.ndarray]:
    """The sum over all rows of arrays by key: added up in tasks first, then over tasks."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict = {}
        for part in parts:
            for key, values in cells(part).items():
                total[key] = total.get(key, 0) + values
        for key, values in total.items():
            yield pd.DataFrame({"key": ["/".join(map(str, key))] * values.size, "cell": np.arange(values.size), "value": values.ravel()})

    found = rows.mapInPandas(run, "key string, cell int, value double").groupBy("key", "cell").agg(F.sum("value").alias("value"))
    out: dict = {}
    for key, part in found.toPandas().groupby("key"):
        out[tuple(map(int, key.split("/")))] = part.sort_values("cell")["value"].to_numpy()
    return out


def parts_of(part: pd.DataFrame, outer: int, inner: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """outer fold, inner fold or REFIT, rows to learn from and held-out rows."""
    own = part["outer"].to_numpy()
    for k in range(outer):
        within = part[f"inner_{k}"].to_numpy(float)
        yield k, REFIT, own != k, own == k
        for i in range(inner):
            yield k, i, (own != k) & (within != i), (own != k) & (within == i)


class Search:
    """All fits of the trials, and how often each class was hit on held-out rows."""

    def __init__(self, rows: DataFrame, columns: list[str], tried: list[Trial], outer: int = 5, inner: int = 4, features: int = 32, seed: int = 42):
        self.columns, self.tried, self.outer, self.inner, self.features = columns, tried, outer, inner, features
        p, spark = len(columns), rows.sparkSession
        strides = sorted({t.stride for t in tried})
        if "stride" in rows.columns:
            rows = rows.filter(F.col("stride").isin(strides))

        def by_stride(part: pd.DataFrame) -> Iterator[tuple[int, pd.DataFrame]]:
            yield from part.groupby("stride", sort=False) if "stride" in part else [(s, part) for s in strides]

        def moments(part: pd.DataFrame) -> dict:
            out: dict = {}
            for s, own_rows in by_stride(part):
                x, y = own_rows[columns].to_numpy(float), own_rows["y"].to_numpy(int)
                for k, i, learn, _ in parts_of(own_rows, outer, inner):
                    own = x[learn]
                    out[s, k, i] = np.concatenate((np.bincount(y[learn], minlength=2), own.sum(0), (own.T @ own).ravel()))
            return out

        self.models: dict[tuple[int, int, int], Model] = {}
        for (s, k, i), v in summed(rows, moments).items():
            for t, trial in ((t, trial) for t, trial in enumerate(tried) if trial.stride == s):
                self.models[k, i, t] = Model(v[:2], v[2 : 2 + p], v[2 + p :].reshape(p, p), trial, features, seed + t)
        shared = spark.sparkContext.broadcast(self.models)

        def products(part: pd.DataFrame) -> dict:
            out: dict = {}
            for s, own_rows in by_stride(part):
                x, y = own_rows[columns].to_numpy(float), own_rows["y"].to_numpy(int)
                for k, i, learn, _ in parts_of(own_rows, outer, inner):
                    for t in (t for t, trial in enumerate(tried) if trial.stride == s):
                        model = shared.value[k, i, t]
                        z, w = model.mapped(model.components(x[learn])), model.weight[y[learn]]
                        out[k, i, t] = np.concatenate((((z * w[:, None]).T @ z).ravel(), (z * w[:, None]).T @ (2.0 * y[learn] - 1)))
            return out

        size = features + 1
        for key, v in summed(rows, products).items():
            self.models[key].solve(v[: size * size].reshape(size, size), v[size * size :])
        solved = spark.sparkContext.broadcast(self.models)
        tasks = sorted(r[0] for r in rows.select("task").distinct().collect())

        def counts(part: pd.DataFrame) -> dict:
            out: dict = {}
            for s, own_rows in by_stride(part):
                x, y, task = own_rows[columns].to_numpy(float), own_rows["y"].to_numpy(int), own_rows["task"].to_numpy()
                for k, i, _, held in parts_of(own_rows, outer, inner):
                    for t in (t for t, trial in enumerate(tried) if trial.stride == s):
                        model = solved.value[k, i, t]
                        found = model.classes(model.components(x[held]))
                        for j, name in enumerate(tasks):
                            mine = task[held] == name
                            out[k, i, t, j] = np.bincount(2 * y[held][mine] + found[mine], minlength=4).astype(float)
            return out

        held = [(k, i, t, tasks[j], *map(int, v)) for (k, i, t, j), v in summed(rows, counts).items()]
        #: outer, inner, trial, task, tn, fp, fn, tp: one row for each fit and task.
        self.counts = spark.createDataFrame(held or [(0, 0, 0, "", 0, 0, 0, 0)][:0], "outer int, inner int, trial int, task string, tn long, fp long, fn long, tp long")

    def scores(self) -> DataFrame:
        """outer, inner, trial, mcc: the harmonic mean over both tasks."""
        by_task = metrics(self.counts, ["outer", "inner", "trial", "task"])
        wide = by_task.groupBy("outer", "inner", "trial").agg(F.min_by("mcc", "task").alias("_a"), F.max_by("mcc", "task").alias("_b"))
        return wide.select("outer", "inner", "trial", harmonic(F.col("_a"), F.col("_b")).alias("mcc"))

    def trial_table(self) -> DataFrame:
        """outer, trial, its parameters, mean and deviation over inner folds, objective (mean - 0.5 deviation), chosen."""
        spark = self.counts.sparkSession
        known = spark.createDataFrame([(t, x.stride, x.penalty, x.gamma, x.share) for t, x in enumerate(self.tried)], "trial int, stride int, penalty double, gamma double, share double")
        found = self.scores().filter(F.col("inner") != REFIT).groupBy("outer", "trial").agg(F.avg("mcc").alias("mean"), F.stddev_pop("mcc").alias("std"))
        found = found.withColumn("objective", F.col("mean") - 0.5 * F.col("std"))
        best = Window.partitionBy("outer").orderBy(F.desc("objective"), "trial")
        return found.withColumn("chosen", F.row_number().over(best) == 1).join(known, "trial").select("outer", "trial", "stride", "penalty", "gamma", "share", "mean", "std", "objective", "chosen")

    def chosen(self) -> dict[int, int]:
        """The trial that each outer fold picks."""
        return {r["outer"]: r["trial"] for r in self.trial_table().filter("chosen").select("outer", "trial").collect()}

    def nested(self) -> DataFrame:
        """outer, trial, task and all scores of the chosen trial, fitted anew on all rows that the fold learns from, on the
        rows that it holds out."""
        picked = self.trial_table().filter("chosen").select("outer", "trial")
        held = self.counts.filter(F.col("inner") == REFIT).join(F.broadcast(picked), ["outer", "trial"])  # a row for each fold
        return metrics(held, ["outer", "trial", "task"])

    def final(self) -> DataFrame:
        """picked_by, trial, mean and std of MCC: each fold's choice on all folds."""
        picked = self.trial_table().filter("chosen").select(F.col("outer").alias("picked_by"), "trial")
        every = self.scores().filter(F.col("inner") == REFIT).select("outer", "trial", "mcc")
        return every.join(F.broadcast(picked), "trial").groupBy("picked_by", "trial").agg(F.avg("mcc").alias("mean"), F.stddev_pop("mcc").alias("std"))

    def component_importance(self, rows: DataFrame, repeats: int = 25) -> DataFrame:
        """outer, component, importance: by how much the balanced accuracy on held-out rows falls when a component is dealt
        anew among them, on average over ``repeats``."""
        models = {k: self.models[k, REFIT, t] for k, t in self.chosen().items()}
        shared, columns = rows.sparkSession.sparkContext.broadcast(models), self.columns
        if "stride" in rows.columns:
            picked = {k: self.tried[t].stride for k, t in self.chosen().items()}
            rows = rows.filter(reduce(or_, ((F.col("outer") == k) & (F.col("stride") == s) for k, s in picked.items()), F.lit(False)))

        def project(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                out = part[["pid", "task", "y", "outer"]].copy()
                found = np.empty(len(part), object)
                for k, own in part.groupby("outer").indices.items():
                    for at, c in zip(own, shared.value[k].components(part[columns].to_numpy(float)[own]), strict=True):
                        found[at] = c
                out["components"] = found
                yield out

        # Written once: projected rows are read four times, and no task needs a second Python beside the one that classifies.
        held = staged(rows.mapInPandas(project, "pid long, task string, y int, outer int, components array<double>"), "components")
        n = held.groupBy("outer").agg(F.count("*").alias("_n"))
        dealt = held.join(n, "outer").select("*", F.explode(F.sequence(F.lit(0), F.size("components") - 1)).alias("component"))
        dealt = dealt.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
        dealt = dealt.withColumn("_block", F.pmod(F.xxhash64("pid", "task", "repeat"), F.ceil(F.col("_n") / BLOCK)))
        keys = ["outer", "component", "repeat", "_block"]
        own = F.row_number().over(Window.partitionBy(*keys).orderBy("pid", "task"))
        other = F.row_number().over(Window.partitionBy(*keys).orderBy(F.xxhash64("pid", "task", "repeat", "component", F.lit("dealt")), "pid", "task"))
        placed = dealt.withColumn("_own", own).withColumn("_other", other)
        values = placed.select(*keys, F.col("_other").alias("_own"), F.get("components", F.col("component")).alias("_new"))
        mixed = placed.join(values, [*keys, "_own"]).select("outer", "component", "repeat", "y", F.transform("components", lambda c, i: F.when(i == F.col("component"), F.col("_new")).otherwise(c)).alias("components"))
        plain = held.select("outer", F.lit(-1).alias("component"), F.lit(0).alias("repeat"), "y", "components")

        def classify(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                found = np.zeros(len(part), np.int32)
                for k, rows_ in part.groupby("outer").indices.items():
                    found[rows_] = shared.value[k].classes(np.stack(part["components"].to_numpy()[rows_]))
                yield part[["outer", "component", "repeat", "y"]].assign(yhat=found)

        def rate(part: DataFrame) -> DataFrame:
            told = part.mapInPandas(classify, "outer int, component int, repeat int, y int, yhat int")
            hit = (F.col("y") == F.col("yhat")).cast("double")
            return told.groupBy("outer", "component", "repeat", "y").agg(F.avg(hit).alias("_r")).groupBy("outer", "component", "repeat").agg(F.avg("_r").alias("_b"))

        base = rate(plain).select("outer", F.col("_b").alias("_base"))
        return rate(mixed).join(base, "outer").groupBy("outer", "component").agg(F.avg(F.col("_base") - F.col("_b")).alias("importance"))

    def loadings(self) -> DataFrame:
        """outer, feature, component, loading of each fold's chosen fit."""
        rows = [(k, c, j, float(v)) for k, t in self.chosen().items() for c, own in zip(self.columns, self.models[k, REFIT, t].loadings, strict=True) for j, v in enumerate(own)]
        return self.counts.sparkSession.createDataFrame(rows, "outer int, feature string, component int, loading double")


def back_project(importance: DataFrame, loadings: DataFrame) -> DataFrame:
    """outer, feature, importance: absolute loadings times the components' importance, 1 in all of a fold; 0 where the
    importances add up to nothing."""
    summed_ = loadings.join(importance, ["outer", "component"]).groupBy("outer", "feature").agg(F.sum(F.abs("loading") * F.col("importance")).alias("_s"))
    return summed_.select("outer", "feature", F.coalesce(F.try_divide(F.col("_s"), F.sum("_s").over(Window.partitionBy("outer"))), F.lit(0.0)).alias("importance"))


def fold_summary(importance: DataFrame, features: DataFrame, most: int = 20) -> DataFrame:
    """feature, mean, std over the folds that have it (0 without any), the ``most`` largest first."""
    found = importance.groupBy("feature").agg(F.avg("importance").alias("mean"), F.stddev_pop("importance").alias("std"))
    every = features.select("feature").distinct().join(found, "feature", "left").na.fill(0.0, ["mean", "std"])
    return every.orderBy(F.desc("mean"), "feature").limit(most)
