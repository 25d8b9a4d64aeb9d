"""Scores of predictions, screening of features and tests on designs, as grouped aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def confusion(pred: DataFrame, keys: list[str]) -> DataFrame:
    """keys, tn, fp, fn, tp."""
    y, h = F.col("y"), F.col("yhat")
    return pred.groupBy(*keys).agg(F.count_if((y == 0) & (h == 0)).alias("tn"), F.count_if((y == 0) & (h == 1)).alias("fp"), F.count_if((y == 1) & (h == 0)).alias("fn"), F.count_if((y == 1) & (h == 1)).alias("tp"))


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def metrics(counts: DataFrame, keys: list[str]) -> DataFrame:
    """All scores of 2 x 2 counts; a zero denominator scores 0; f1, precision and recall weigh by support."""
    tn, fp, fn, tp = (F.col(c).cast("double") for c in ("tn", "fp", "fn", "tp"))
    n, pos, neg = tn + fp + fn + tp, fn + tp, tn + fp
    sens, spec, p1, p0 = _ratio(tp, pos), _ratio(tn, neg), _ratio(tp, tp + fp), _ratio(tn, tn + fn)
    f1, f0 = _ratio(2 * tp, 2 * tp + fp + fn), _ratio(2 * tn, 2 * tn + fp + fn)
    weigh = lambda a, b: _ratio(a * pos + b * neg, n)
    mcc = _ratio(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)))
    return counts.select(
        *keys,
        _ratio(tp + tn, n).alias("accuracy"),
        ((sens + spec) / 2).alias("balanced_accuracy"),
        weigh(f1, f0).alias("f1"),
        weigh(p1, p0).alias("precision"),
        weigh(sens, spec).alias("recall"),
        sens.alias("sensitivity"),
        spec.alias("specificity"),
        mcc.alias("mcc"),
    )


def harmonic(a: Column, b: Column) -> Column:
    """Harmonic mean; the smaller one if any is not positive."""
    return F.when((a <= 0) | (b <= 0), F.least(a, b)).otherwise(2 * a * b / (a + b))


def cross_task(scores: DataFrame, keys: list[str], metric: str) -> DataFrame:
    """The harmonic mean of a metric over tasks A and B."""
    wide = scores.groupBy(*keys).agg(F.max(F.when(F.col("task") == "A", F.col(metric))).alias("_a"), F.max(F.when(F.col("task") == "B", F.col(metric))).alias("_b"))
    return wide.select(*keys, harmonic(F.col("_a"), F.col("_b")).alias(metric))


def cross_all(scores: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """keys and of every named score the harmonic mean over both tasks (smaller if any is not positive), in one pass."""
    wide = scores.groupBy(*keys).agg(*(F.max(F.when(F.col("task") == t, F.col(m))).alias(f"_{t}_{m}") for m in names for t in "AB"))
    return wide.select(*keys, *(harmonic(F.col(f"_A_{m}"), F.col(f"_B_{m}")).alias(m) for m in names))


def delta_mcc(pred: DataFrame, keys: list[str]) -> DataFrame:
    """keys, pid, delta: MCC of all minus MCC without one participant, from totals minus own counts."""
    own = confusion(pred, [*keys, "pid"])
    every = Window.partitionBy(*keys)
    counts = ("tn", "fp", "fn", "tp")
    both = own.select(*keys, "pid", *(F.sum(c).over(every).alias(f"all_{c}") for c in counts), *counts)
    with_all = metrics(both.select(*keys, "pid", *(F.col(f"all_{c}").alias(c) for c in counts)), [*keys, "pid"]).select(*keys, "pid", F.col("mcc").alias("_all"))
    without = metrics(both.select(*keys, "pid", *((F.col(f"all_{c}") - F.col(c)).alias(c) for c in counts)), [*keys, "pid"]).select(*keys, "pid", F.col("mcc").alias("_rest"))
    return with_all.join(without, [*keys, "pid"]).select(*keys, "pid", (F.col("_all") - F.col("_rest")).alias("delta"))


# -- screening -------------------------------------------------------------------------------------------------------
def anova_f(feat: DataFrame, keys: list[str]) -> DataFrame:
    """One-way F of value by y; null where a group or the error is empty."""
    groups = feat.groupBy(*keys, "y").agg(F.count("value").alias("n"), F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q"))
    total = groups.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("b"), F.count("*").alias("k"))
    between = F.col("b") - F.col("s") * F.col("s") / F.col("n")
    within = F.col("q") - F.col("b")
    return total.select(*keys, F.try_divide(F.try_divide(between, F.col("k") - 1), F.try_divide(within, F.col("n") - F.col("k"))).alias("f"))


def correlation(df: DataFrame, keys: list[str], x: str, y: str, out: str) -> DataFrame:
    """Pearson's r from moments; null for a constant side."""
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    sx, sy = F.stddev_pop(a), F.stddev_pop(b)
    return df.groupBy(*keys).agg(F.try_divide(F.covar_pop(a, b), sx * sy).alias(out))


def chi_square(df: DataFrame, keys: list[str], a: str, y: str) -> DataFrame:
    """keys, statistic, df of the contingency table of a and a binary y, with Yates' correction where df is 1; null where a side has
    one level. Levels that meet no row of a class count as empty cells. Rows are counted by level first."""
    levels = df.filter(F.col(a).isNotNull() & F.col(y).isNotNull()).groupBy(*keys, a).agg(F.count_if(F.col(y) == 0).alias("_n0"), F.count_if(F.col(y) == 1).alias("_n1"))
    every = Window.partitionBy(*keys)
    totals = levels.select(*keys, "_n0", "_n1", F.sum("_n0").over(every).alias("_t0"), F.sum("_n1").over(every).alias("_t1"), F.count("*").over(every).alias("_k"))
    n, row = F.col("_t0") + F.col("_t1"), F.col("_n0") + F.col("_n1")

    def cell(seen: str, total: str) -> Column:
        e = row * F.col(total) / n
        off = F.abs(F.col(seen) - e)
        off = F.when(F.col("_k") == 2, F.greatest(off - F.least(F.lit(0.5), off), F.lit(0.0))).otherwise(off)
        return off * off / e

    whole = totals.filter("_t0 > 0 AND _t1 > 0 AND _k > 1")
    return whole.groupBy(*keys).agg(F.sum(cell("_n0", "_t0") + cell("_n1", "_t1")).alias("statistic"), F.max(F.col("_k") - 1).alias("df"))


def rank_pair(scores: DataFrame, metric: str) -> DataFrame:
    """feature, score: harmonic mean of the absolute scores in both tasks, best first by place."""
    wide = scores.groupBy("feature").agg(F.max(F.when(F.col("task") == "O", F.abs(metric))).alias("_a"), F.max(F.when(F.col("task") == "F", F.abs(metric))).alias("_b"))
    both = wide.filter("_a IS NOT NULL AND _b IS NOT NULL").select("feature", F.when((F.col("_a") <= 0) | (F.col("_b") <= 0), 0.0).otherwise(2 * F.col("_a") * F.col("_b") / (F.col("_a") + F.col("_b"))).alias("score"))
    return both


def placed(scores: DataFrame, keys: list[str], by: str) -> DataFrame:
    """``place`` of each feature by score, best first, ties by name."""
    own = Window.partitionBy(*keys).orderBy(F.desc(by), "feature")
    return scores.withColumn("place", F.row_number().over(own))


# -- designs -----------------------------------------------------------------------------------------------------------
def rm_anova(dsg: DataFrame) -> DataFrame:
    """source, ss, df1, df2, f, np2 of a two-way within-subject design (subject, a, b, value), complete cells. The sums of every set of
    factors come from one pass over the rows."""
    sets = {"t": [], "s": ["subject"], "a": ["a"], "b": ["b"], "ab": ["a", "b"], "as": ["subject", "a"], "bs": ["subject", "b"]}
    columns = ["subject", "a", "b"]
    grouped = dsg.groupingSets([[F.col(c) for c in by] for by in sets.values()], *columns)
    sums = grouped.agg(F.sum("value").alias("v"), F.count("*").alias("n"), F.sum(F.col("value") * F.col("value")).alias("q"), F.grouping_id().alias("id"))
    # A column that a set leaves out has its bit set, the first column the highest one.
    place = {k: sum(1 << (2 - i) for i, c in enumerate(columns) if c not in by) for k, by in sets.items()}
    k = lambda name: F.sum(F.when(F.col("id") == place[name], F.col("v") * F.col("v") / F.col("n"))).alias(name)
    levels = lambda name: F.count_if(F.col("id") == place[name])
    one = sums.agg(*(k(name) for name in sets), F.max(F.when(F.col("id") == place["t"], F.col("q"))).alias("q"), levels("s").alias("ns"), levels("a").alias("na"), levels("b").alias("nb"))
    c = F.col
    ss = {
        "a": (c("a") - c("t"), c("as") - c("a") - c("s") + c("t"), c("na") - 1, (c("na") - 1) * (c("ns") - 1)),
        "b": (c("b") - c("t"), c("bs") - c("b") - c("s") + c("t"), c("nb") - 1, (c("nb") - 1) * (c("ns") - 1)),
        "a * b": (
            c("ab") - c("a") - c("b") + c("t"),
            c("q") - c("ab") - c("as") - c("bs") + c("a") + c("b") + c("s") - c("t"),
            (c("na") - 1) * (c("nb") - 1),
            (c("na") - 1) * (c("nb") - 1) * (c("ns") - 1),
        ),
    }
    rows = [F.struct(F.lit(k).alias("source"), s.alias("ss"), d1.alias("df1"), d2.alias("df2"), F.try_divide(s / d1, e / d2).alias("f"), F.try_divide(s, s + e).alias("np2")) for k, (s, e, d1, d2) in ss.items()]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def paired_t(dsg: DataFrame, factor: str = "a") -> DataFrame:
    """x, y, t, df, cohen for each pair of levels, other factors averaged."""
    mean = dsg.groupBy("subject", factor).agg(F.avg("value").alias("v"))
    other = mean.select("subject", F.col(factor).alias("y"), F.col("v").alias("w"))
    d = F.col("v") - F.col("w")
    pairs = mean.withColumnRenamed(factor, "x").join(other, "subject").filter("x < y")
    sd = F.sqrt((F.var_samp("v") + F.var_samp("w")) / 2)
    return pairs.groupBy("x", "y").agg(F.try_divide(F.avg(d), F.stddev_samp(d) / F.sqrt(F.count("*"))).alias("t"), (F.count("*") - 1).alias("df"), F.try_divide(F.avg("v") - F.avg("w"), sd).alias("cohen"))


def holm(p: DataFrame, keys: list[str], c: str = "p") -> DataFrame:
    """p_holm: running maximum of (m - rank + 1) p in order of p, at most 1."""
    own, every = Window.partitionBy(*keys).orderBy(c), Window.partitionBy(*keys)
    scaled = p.withColumn("_s", (F.count("*").over(every) - F.row_number().over(own) + 1) * F.col(c))
    return scaled.withColumn("p_holm", F.least(F.lit(1.0), F.max("_s").over(own.rowsBetween(Window.unboundedPreceding, 0)))).drop("_s")


def cochran_q(binary: DataFrame) -> DataFrame:
    """q and df over subjects with all conditions (subject, condition, x in 0/1)."""
    k = binary.agg(F.count_distinct("condition").alias("k"))
    whole = binary.groupBy("subject").agg(F.count("*").alias("n"), F.sum("x").alias("l"))
    rows = whole.join(F.broadcast(k), F.col("n") == F.col("k")).select("subject", "l")
    cols = binary.join(rows, "subject").groupBy("condition").agg(F.sum("x").alias("g"))
    a = cols.agg(F.sum("g").alias("sg"), F.sum(F.col("g") * F.col("g")).alias("sg2"), F.count("*").alias("k"))
    b = rows.agg(F.sum("l").alias("sl"), F.sum(F.col("l") * F.col("l")).alias("sl2"))
    kk = F.col("k")
    q = F.try_divide((kk - 1) * (kk * F.col("sg2") - F.col("sg") * F.col("sg")), kk * F.col("sl") - F.col("sl2"))
    return a.join(F.broadcast(b), F.lit(True)).select(q.alias("q"), (kk - 1).alias("df"))


def mcnemar(binary: DataFrame) -> DataFrame:
    """x, y, b, c, statistic (with continuity correction; 0 without discordant pairs) for condition pairs."""
    other = binary.select("subject", F.col("condition").alias("y"), F.col("x").alias("w"))
    pairs = binary.select("subject", F.col("condition").alias("cx"), "x").join(other, "subject").filter("cx < y")
    b, c = F.count_if((F.col("x") == 1) & (F.col("w") == 0)), F.count_if((F.col("x") == 0) & (F.col("w") == 1))
    stat = F.coalesce(F.try_divide((F.abs(b - c) - 1) * (F.abs(b - c) - 1), (b + c)).cast("double"), F.lit(0.0))
    return pairs.groupBy(F.col("cx").alias("x"), "y").agg(b.alias("b"), c.alias("c"), stat.alias("statistic"))
