"""Tables of designs: within-subject analysis of variance with sphericity, pairwise and categorical tests with p
values, contrasts of a logistic model."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import staged
from . import models as L
from .evaluation import cochran_q, holm, mcnemar, paired_t, rm_anova


def covariances(cells: DataFrame, by: list[str]) -> DataFrame:
    """Sample covariance over subjects of each two conditions: by, by with _2, s. Cells: subject, by, value; conditions are
    the levels of a design, so their pairs are few."""
    other = cells.select("subject", *(F.col(c).alias(f"{c}_2") for c in by), F.col("value").alias("_v"))
    return cells.join(other, "subject").groupBy(*by, *(f"{c}_2" for c in by)).agg(F.covar_samp("value", "_v").alias("s"))


def epsilon(dsg: DataFrame, factors: list[str]) -> DataFrame:
    """One row, eps: Greenhouse and Geisser's of a factor or an interaction, from the covariances of its conditions'
    means, centred over each factor on both sides: tr(D)^2 / (df tr(D D))."""
    means = dsg.groupBy("subject", *factors).agg(F.avg("value").alias("value"))
    d, sides = covariances(means, factors), [*factors, *(f"{c}_2" for c in factors)]
    for c in sides:
        rest = [x for x in sides if x != c]
        d = d.withColumn("s", F.col("s") - F.avg("s").over(Window.partitionBy(*rest)))
    same = reduce(lambda a, b: a & b, (F.col(c) == F.col(f"{c}_2") for c in factors))
    df = reduce(lambda a, b: a * b, (F.count_distinct(c) - 1 for c in factors))
    trace = F.sum(F.when(same, F.col("s")))
    return d.agg(F.least(F.lit(1.0), F.try_divide(trace * trace, df * F.sum(F.col("s") * F.col("s")))).alias("eps"))


def rm_table(dsg: DataFrame) -> DataFrame:
    """source, ss, df1, df2, ms, f, p, p_gg, np2, eps of a two-way within-subject design."""
    eps = reduce(DataFrame.unionByName, (epsilon(dsg, fs).withColumn("_source", F.lit(" * ".join(fs))) for fs in (["a"], ["b"], ["a", "b"])))
    rows = rm_anova(dsg).join(eps, F.col("source") == F.col("_source")).drop("_source")
    d1, d2, e = F.col("df1"), F.col("df2"), F.col("eps")
    tail = lambda a, b: L.p_value(L.f_tail, F.col("f"), a, b)
    return rows.select("source", "ss", "df1", "df2", (F.col("ss") / d1).alias("ms"), "f", tail(d1, d2).alias("p"), tail(d1 * e, d2 * e).alias("p_gg"), "np2", "eps")


def pairwise_table(dsg: DataFrame, factor: str = "a") -> DataFrame:
    """x, y, t, df, p, p_holm, p_bonf, cohen of each two levels, other factors averaged."""
    t = paired_t(dsg, factor)
    p = t.withColumn("p", L.p_value(L.t_tail, F.col("t"), F.col("df"))).withColumn("_all", F.lit(1))
    m = F.count("*").over(Window.partitionBy("_all"))
    return holm(p, ["_all"]).select("x", "y", "t", "df", "p", "p_holm", F.least(F.lit(1.0), F.col("p") * m).alias("p_bonf"), "cohen")


def cochran_table(binary: DataFrame) -> DataFrame:
    return cochran_q(binary).withColumn("p", L.p_value(L.chi2_tail, F.col("q"), F.col("df")))


def mcnemar_table(binary: DataFrame) -> DataFrame:
    """mcnemar with p of one degree of freedom; 1 without discordant pairs."""
    p = L.p_value(L.chi2_tail, F.col("statistic"), F.lit(1))
    return mcnemar(binary).withColumn("p", F.when(F.col("b") + F.col("c") == 0, 1.0).otherwise(p))


def group_table(dsg: DataFrame, by: list[str], most: int = 10) -> DataFrame:
    """by, mean, sd, n, sem, ci: the groups with the largest means, with the half width of the 95 % interval."""
    sem = F.stddev_samp("value") / F.sqrt(F.count("*"))
    found = dsg.groupBy(*by).agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.count("*").alias("n"), sem.alias("sem"), (1.96 * sem).alias("ci"))
    return found.orderBy(F.desc("mean"), *by).limit(most)


def majority(trials: DataFrame, by: list[str], over: str) -> DataFrame:
    """by, x: 1 where the mean of ``correct`` is a half or more for at least half of the levels of ``over``."""
    first = trials.groupBy(*by, over).agg((F.avg("correct") >= 0.5).cast("int").alias("x"))
    return first.groupBy(*by).agg((F.avg("x") >= 0.5).cast("int").alias("x"))


#: Precision of a person's intercept about the common one, and the most steps of a fit.
PRECISION, STEPS = 1.0, 40


def fitted(cells: DataFrame, size: int, precision: float = PRECISION) -> dict:
    """Logistic models fitted all at once: model -> (estimates, standard errors). ``cells``: model, pid, x (``size`` numbers, the first 1), k
    hits of n. Each person has an intercept of its own, drawn to 0 with ``precision``.

    A step of Newton's method needs, for each person, the sums of weights, of weighted x and of residuals. In the system of
    equations a person's row then drops out (Schur's complement), so what is summed over persons, solved here and
    handed back is of the size of the estimates, however many persons there are. Persons stay rows of a written table."""
    spark = cells.sparkSession
    cells = staged(cells, "logistic-cells")
    persons = cells.select("model", "pid").distinct().withColumns({"u": F.lit(0.0), "g": F.lit(0.0), "h": F.lit(1.0), "hx": F.array(*(F.lit(0.0) for _ in range(size)))})
    models = sorted(r[0] for r in cells.select("model").distinct().collect())  # one number each
    beta, step = {m: np.zeros(size) for m in models}, {m: np.zeros(size) for m in models}
    weight, residual = F.col("n") * F.col("p") * (1 - F.col("p")), F.col("k") - F.col("n") * F.col("p")
    x = [F.col("x")[i] for i in range(size)]
    pairs = [(i, j) for i in range(size) for j in range(i, size)]
    errors: dict = {}
    for _ in range(STEPS):
        known = F.broadcast(spark.createDataFrame([(m, beta[m].tolist(), step[m].tolist()) for m in models], "model long, b array<double>, s array<double>"))  # a row for each model
        moved = persons.join(known, "model")
        shift = sum((F.col("hx")[i] * F.col("s")[i] for i in range(1, size)), F.col("hx")[0] * F.col("s")[0])
        moved = moved.select("model", "pid", "b", (F.col("u") + (F.col("g") - shift) / F.col("h")).alias("u"))
        eta = sum((x[i] * F.col("b")[i] for i in range(1, size)), x[0] * F.col("b")[0]) + F.col("u")
        rows = cells.join(moved, ["model", "pid"]).withColumn("p", 1 / (1 + F.exp(-eta)))
        sums = rows.groupBy("model", "pid", "u").agg(
            (F.sum(weight) + precision).alias("h"),
            (F.sum(residual) - precision * F.col("u")).alias("g"),
            F.array(*(F.sum(weight * c) for c in x)).alias("hx"),
            F.array(*(F.sum(residual * c) for c in x)).alias("gx"),
            F.array(*(F.sum(weight * x[i] * x[j]) for i, j in pairs)).alias("hxx"),
        )
        persons = staged(sums, "logistic-persons")
        schur = [F.sum(F.col("hxx")[k] - F.col("hx")[i] * F.col("hx")[j] / F.col("h")) for k, (i, j) in enumerate(pairs)]
        right = [F.sum(F.col("gx")[i] - F.col("hx")[i] * F.col("g") / F.col("h")) for i in range(size)]
        largest = 0.0
        for r in persons.groupBy("model").agg(F.array(*schur).alias("a"), F.array(*right).alias("r")).collect():
            a = np.zeros((size, size))
            for v, (i, j) in zip(r["a"], pairs, strict=True):
                a[i, j] = a[j, i] = v
            inverse = np.linalg.inv(a + 1e-9 * np.eye(size))
            step[r["model"]] = np.clip(inverse @ np.array(r["r"]), -5, 5)
            beta[r["model"]] = beta[r["model"]] + step[r["model"]]
            errors[r["model"]] = np.sqrt(np.maximum(np.diag(inverse), 0))
            largest = max(largest, float(np.abs(step[r["model"]]).max()))
        if largest < 1e-9:
            break
    return {m: (beta[m], errors[m]) for m in models}


def dummies(trials: DataFrame, factors: list[str]) -> list[tuple[str, str, F.Column]]:
    """factor, level, column (1.0 on the level) of each level but the least one; levels of a design are few."""
    found = []
    for f in factors:
        found += [(f, v, (F.col(f) == F.lit(v)).cast("double")) for v in sorted(r[0] for r in trials.select(f).distinct().collect())[1:]]
    return found


def logistic_table(trials: DataFrame, *factors: str, precision: float = PRECISION) -> DataFrame:
    """term, estimate, se, low, high of a binomial model of ``correct`` by the levels of factors, the least level of each being the
    reference, with an intercept for each person. Trials are counted by person and levels before they are fitted."""
    terms = dummies(trials, list(factors))
    counted = trials.groupBy("pid", *factors).agg(F.sum("correct").cast("double").alias("k"), F.count("*").cast("double").alias("n"))
    cells = counted.select(F.lit(0).cast("long").alias("model"), "pid", F.array(F.lit(1.0), *(c for _, _, c in terms)).alias("x"), "k", "n")
    estimates, errors = fitted(cells, 1 + len(terms), precision)[0]
    names = ["intercept", *(f"{f} {v}" for f, v, _ in terms)]
    out = trials.sparkSession.createDataFrame([(t, float(b), float(e)) for t, b, e in zip(names, estimates, errors, strict=True)], "term string, estimate double, se double")
    return out.select("*", (F.col("estimate") - 1.96 * F.col("se")).alias("low"), (F.col("estimate") + 1.96 * F.col("se")).alias("high"))


def contrast_table(trials: DataFrame, factor: str, *others: str, fewest: int = 10, precision: float = PRECISION) -> DataFrame:
    """x, y, estimate, se, low, high, significant for each two levels of a factor: the model on the rows of the two, with the other
    factors, significant where the interval excludes 0; all pairs are fitted at once. Pairs with fewer than ``fewest``
    rows, or of one level, are left out."""
    counts = {r[0]: r[1] for r in trials.groupBy(factor).count().collect()}  # levels of a design
    levels = sorted(counts)
    pairs = [(a, b) for i, a in enumerate(levels) for b in levels[i + 1 :] if counts[a] + counts[b] >= fewest]
    spark, kind = trials.sparkSession, trials.schema[factor].dataType.simpleString()
    shape = "x string, y string, estimate double, se double, low double, high double, significant boolean"
    if not pairs:
        return spark.createDataFrame([], shape)
    terms = dummies(trials, list(others))
    counted = trials.groupBy("pid", factor, *others).agg(F.sum("correct").cast("double").alias("k"), F.count("*").cast("double").alias("n"))
    sides = [(m, v, float(v == b)) for m, (a, b) in enumerate(pairs) for v in (a, b)]
    known = F.broadcast(spark.createDataFrame(sides, f"model long, _level {kind}, _second double"))  # pairs of levels
    cells = counted.join(known, F.col(factor) == F.col("_level")).select("model", "pid", F.array(F.lit(1.0), F.col("_second"), *(c for _, _, c in terms)).alias("x"), "k", "n")
    found = fitted(cells, 2 + len(terms), precision)
    rows = []
    for m, (a, b) in enumerate(pairs):
        e, s = float(found[m][0][1]), float(found[m][1][1])
        rows.append((str(a), str(b), e, s, e - 1.96 * s, e + 1.96 * s, e - 1.96 * s > 0 or e + 1.96 * s < 0))
    return spark.createDataFrame(rows, shape)
