"""Models and importances: Spark ML on vectors assembled from long features."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.ml.classification import LinearSVC
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def scaled(train: DataFrame, test: DataFrame, columns: list[str]) -> DataFrame:
    """Test columns as z-scores of the training set, population deviation, constant columns by 1."""
    fit = train.agg(*(F.avg(c).alias(f"_m_{c}") for c in columns), *(F.stddev_pop(c).alias(f"_s_{c}") for c in columns))
    joined = test.join(F.broadcast(fit), F.lit(True))  # the fit is one row
    z = lambda c: (F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") > 0, F.col(f"_s_{c}")).otherwise(1.0)
    return joined.select(*(c for c in test.columns if c not in columns), *(z(c).alias(c) for c in columns))


def principal_components(df: DataFrame, columns: list[str], share: float) -> tuple[DataFrame, int]:
    """Projections on the components that hold ``share`` of the variance; columns are centred first."""
    vec = VectorAssembler(inputCols=columns, outputCol="_v").transform(scaled(df, df, columns))
    model = PCA(k=len(columns), inputCol="_v", outputCol="_p").fit(vec)
    k = int(np.searchsorted(np.cumsum(model.explainedVariance.toArray()), share - 1e-12) + 1)
    k = min(k, len(columns))
    arr = vector_to_array("_p")
    return model.transform(vec).select(*(c for c in df.columns if c not in columns), *(arr[i].alias(f"pc{i}") for i in range(k))), k


def fourier_features(df: DataFrame, columns: list[str], n: int, gamma: float, seed: int = 7) -> DataFrame:
    """rf0..: random Fourier features of an RBF kernel as column expressions."""
    rng = np.random.default_rng(seed)
    w, b = rng.normal(0, math.sqrt(2 * gamma), (n, len(columns))), rng.uniform(0, 2 * math.pi, n)
    make = lambda k: F.cos(sum((F.col(c) * float(w[k, i]) for i, c in enumerate(columns)), F.lit(float(b[k])))) * math.sqrt(2 / n)
    return df.select("*", *(make(k).alias(f"rf{k}") for k in range(n)))


def classify(train: DataFrame, test: DataFrame, columns: list[str], reg: float = 0.01) -> DataFrame:
    """test with ``yhat`` of a class-balanced linear classifier of the columns."""
    n = train.groupBy("y").agg(F.count("*").alias("_n"))
    total = Window.partitionBy()
    weights = n.withColumn("_w", F.sum("_n").over(total) / (2 * F.col("_n"))).select("y", "_w")
    assembler = VectorAssembler(inputCols=columns, outputCol="_v")
    model = LinearSVC(featuresCol="_v", labelCol="y", weightCol="_w", regParam=reg, maxIter=30, predictionCol="yhat").fit(assembler.transform(train.join(F.broadcast(weights), "y")))
    return model.transform(assembler.transform(test)).drop("_v", "rawPrediction").withColumn("yhat", F.col("yhat").cast("int"))


# -- tails of distributions ---------------------------------------------------------------------------------------------------
def _beta_cf(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function by Lentz's method."""
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / (c if abs(c) > tiny else tiny)
            h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return h


def beta_share(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x))
    return front * _beta_cf(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_cf(b, a, 1 - x) / b


def f_tail(f: float, d1: float, d2: float) -> float:
    return beta_share(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)) if f > 0 else 1.0


def t_tail(t: float, df: float) -> float:
    """Two-sided."""
    return beta_share(df / 2, 0.5, df / (df + t * t))


def chi2_tail(x: float, df: float) -> float:
    a, x = df / 2, x / 2
    if x <= 0:
        return 1.0
    if x < a + 1:
        term = total = 1 / a
        n = a
        while term > total * 1e-16:
            n += 1
            term *= x / n
            total += term
        return 1 - total * math.exp(-x + a * math.log(x) - math.lgamma(a))
    tiny, b = 1e-300, x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return math.exp(-x + a * math.log(x) - math.lgamma(a)) * h


def ks_tail(d: float, n: float, m: float) -> float:
    """Asymptotic two-sample Kolmogorov-Smirnov tail."""
    z = d * math.sqrt(n * m / (n + m))
    return 1.0 if z < 0.2 else min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * z * z) for k in range(1, 101))))


#: Places of the grid inside the band up to which the Kolmogorov-Smirnov tail is counted exactly, and diagonals.
EXACT, DIAGONALS = 10**9, 2 * 10**6


def ks_two_sided(d: float, n: float, m: float) -> float:
    """Two-sample Kolmogorov-Smirnov tail: the share of the ways to mix both samples on which their distribution functions come as far
    apart as d. A way is a path through the grid of n by m; going diagonal by diagonal, each place holds the chance
    that a path to it has left the band of |i / n - j / m| < d. Only the band is walked, as all beyond it is 1. Only sums of positive
    numbers, so small tails keep their digits. Ties do not enter but through d. Beyond ``EXACT`` places or ``DIAGONALS`` the limit's tail."""
    n, m = int(n), int(m)
    if n > m:
        n, m = m, n
    far = round(d * n * m)
    if n == 0 or 2 * far > EXACT or n + m > DIAGONALS:
        return ks_tail(d, n, m)
    if far == 0:
        return 1.0
    i = np.arange(n + 1)
    out = np.ones(n + 2)  # place i is held at i + 1
    out[1], low = 0.0, 0
    for s in range(1, n + m + 1):
        first, last = max(0, s - m, (s * n - far) // (n + m) + 1), min(n, s, -((-s * n - far) // (n + m)) - 1)
        if first > last:
            return 1.0
        own = i[first : last + 1]
        stepped = out[first + 1 : last + 2] * (s - own) / s
        stepped += out[first : last + 1] * own / s
        out[first + 1 : last + 2] = stepped
        out[low + 1 : first + 1], low = 1.0, first
    return float(min(1.0, out[n + 1]))


def p_value(tail, *args: Column) -> Column:
    """A tail over already aggregated rows; null where an argument is."""

    @F.pandas_udf("double")
    def run(*columns: pd.Series) -> pd.Series:
        return pd.Series([None if any(v is None or v != v for v in row) else tail(*map(float, row)) for row in zip(*columns, strict=True)], dtype="float64")

    return run(*(a.cast("double") for a in args))
