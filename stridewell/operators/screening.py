"""Screens of features against a binary label: the same statistics for the label of the own task (within) and
of the other one (cross), p values, and what passes in both tasks.

Input of a screen: pid, task, feature, value, y in long form. All statistics are grouped aggregates; ranks, distribution
functions and neighbours come from blocks of values between quantiles, so one feature's rows need not meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import models as L
from .evaluation import anova_f, chi_square, correlation

KEYS = ["variant", "task", "feature"]
#: Fixed values of the keep rules: largest p, least correlation, least mutual information.
MOST_P, LEAST_R, LEAST_MI = 0.05, 0.2, 0.05
#: Blocks that the values of a feature are cut into, between quantiles.
BLOCKS = 32


def both_ways(feat: DataFrame) -> DataFrame:
    """variant, pid, task, feature, value, y: the features with the label of their own task, and with that of the
    person's other task."""
    label = feat.select(F.col("pid").alias("_pid"), F.col("task").alias("_task"), F.col("y").alias("_y")).distinct()
    other = feat.join(label, (F.col("pid") == F.col("_pid")) & (F.col("task") != F.col("_task")))
    columns = ["pid", "task", "feature", "value"]
    return feat.select(F.lit("within").alias("variant"), *columns, "y").unionByName(other.select(F.lit("cross").alias("variant"), *columns, F.col("_y").alias("y")))


def bounds(rows: DataFrame, keys: list[str], by: str) -> DataFrame:
    """keys, _bounds: the inner quantiles of ``by``, at which its values are cut into blocks of about equal size."""
    shares = F.array(*(F.lit(k / BLOCKS) for k in range(1, BLOCKS)))
    return rows.groupBy(*keys).agg(F.array_distinct(F.percentile_approx(by, shares, F.lit(20 * BLOCKS))).alias("_bounds"))


def block_of(x: Column) -> Column:
    """The block of a value: how many bounds lie under it."""
    return F.size(F.filter("_bounds", lambda b: b < x))


def running(counts: DataFrame, keys: list[str], by: str, *sums: str) -> DataFrame:
    """``counts``, one row for each value of ``by``, with before_<c>: the sum of column c over smaller values.

    Values are cut into blocks at quantiles; blocks are summed by themselves and then added up, so no task sorts
    all values of a group."""
    placed = counts.join(bounds(counts, keys, by), keys).withColumn("_block", block_of(F.col(by))).drop("_bounds")
    whole = placed.groupBy(*keys, "_block").agg(*(F.sum(c).alias(f"_all_{c}") for c in sums))
    above = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    whole = whole.select(*keys, "_block", *(F.coalesce(F.sum(f"_all_{c}").over(above), F.lit(0)).alias(f"_up_{c}") for c in sums))
    within = Window.partitionBy(*keys, "_block").orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    joined = placed.join(whole, [*keys, "_block"])
    before = [(F.col(f"_up_{c}") + F.coalesce(F.sum(c).over(within), F.lit(0))).alias(f"before_{c}") for c in sums]
    return joined.select(*counts.columns, *before)


def screen_f(rows: DataFrame) -> DataFrame:
    """KEYS, value (F), p."""
    n = rows.groupBy(*KEYS).agg(F.count("value").alias("n"), F.count_distinct("y").alias("k"))
    found = anova_f(rows, KEYS).join(n, KEYS)
    return found.select(*KEYS, F.col("f").alias("value"), L.p_value(L.f_tail, F.col("f"), F.col("k") - 1, F.col("n") - F.col("k")).alias("p"))


def screen_pearson(rows: DataFrame) -> DataFrame:
    return correlation(rows, KEYS, "value", "y", "r").select(*KEYS, F.col("r").alias("value"))


def screen_spearman(rows: DataFrame) -> DataFrame:
    """Correlation of average ranks, from the counts of each value and class."""
    counts = rows.groupBy(*KEYS, "value").agg(F.count_if(F.col("y") == 0).alias("zero"), F.count_if(F.col("y") == 1).alias("one"))
    ranked = running(counts, KEYS, "value", "zero", "one")
    own = F.col("zero") + F.col("one")
    rank = F.col("before_zero") + F.col("before_one") + (own + 1) / 2
    n, a, q, ones = F.sum(own), F.sum(own * rank), F.sum(own * rank * rank), F.sum("one")
    # Ranks of the classes: all zeros share one rank and all ones another.
    shared = F.sum(F.col("one") * rank)
    covariance = shared / n - a / n * ones / n
    spread = F.sqrt(q / n - (a / n) * (a / n)) * F.sqrt(ones / n - (ones / n) * (ones / n))
    return ranked.groupBy(*KEYS).agg(F.try_divide(covariance, spread).alias("value"))


def screen_point_biserial(rows: DataFrame) -> DataFrame:
    """KEYS, value (r), t, p with n - 2 degrees of freedom."""
    n = rows.groupBy(*KEYS).agg(F.count("value").alias("n"))
    r = F.col("value")
    found = screen_pearson(rows).join(n, KEYS).withColumn("t", r * F.sqrt(F.try_divide(F.col("n") - 2, 1 - r * r)))
    return found.select(*KEYS, "value", "t", L.p_value(L.t_tail, F.col("t"), F.col("n") - 2).alias("p"))


def screen_ks(rows: DataFrame) -> DataFrame:
    """KEYS, value (largest distance of the two classes' distribution functions), p: exact where the paths' band holds at most ``models.EXACT``
    places, from there on the limit's."""
    counts = rows.groupBy(*KEYS, "value").agg(F.count_if(F.col("y") == 0).alias("zero"), F.count_if(F.col("y") == 1).alias("one"))
    total = counts.groupBy(*KEYS).agg(F.sum("zero").alias("n"), F.sum("one").alias("m"))
    gap = F.abs(F.try_divide(F.col("before_zero") + F.col("zero"), F.col("n")) - F.try_divide(F.col("before_one") + F.col("one"), F.col("m")))
    found = running(counts, KEYS, "value", "zero", "one").join(total, KEYS).groupBy(*KEYS, "n", "m").agg(F.max(gap).alias("value"))
    return found.select(*KEYS, "value", L.p_value(L.ks_two_sided, F.col("value"), F.col("n"), F.col("m")).alias("p"))


def screen_mutual_information(rows: DataFrame, k: int = 3) -> DataFrame:
    """KEYS, value: the nearest-neighbour estimate of the mutual information of a continuous value and a class (Ross 2014). A row's
    radius is the distance to its k-th neighbour in its class (of a class of k rows or fewer the last one; a class of one
    row takes no part); m counts the rows of all classes closer than that, or where the radius is 0 those of the same value.

    Values are cut into blocks between quantiles. A class's last k values before a block and first k after it are its
    halo, so the k-th neighbour is found inside the block; how many values lie under an end of a radius is asked of the
    block that holds that end. No task needs all values of a feature."""
    known = rows.filter(F.col("value").isNotNull() & ~F.isnan("value")).select(*KEYS, "y", "pid", "value")
    sizes = known.groupBy(*KEYS, "y").agg(F.count("*").alias("_c")).filter("_c > 1")
    base = known.join(sizes, [*KEYS, "y"])
    cuts = bounds(base, KEYS, "value")
    own = [*KEYS, "y", "_block"]
    base = base.join(cuts, KEYS).withColumn("_block", block_of(F.col("value")))
    up = Window.partitionBy(*own).orderBy("value", "pid")
    base = base.withColumn("_i", F.row_number().over(up)).withColumn("_left", F.count("*").over(Window.partitionBy(*own)) - F.col("_i"))

    # The k values of a class at either end of a block, and what reaches the other blocks of them.
    listed = F.array_sort(F.collect_list(F.when(F.col("_i") <= k, F.col("value")))), F.array_sort(F.collect_list(F.when(F.col("_left") < k, F.col("value"))))
    ends = base.groupBy(*own).agg(listed[0].alias("_first"), listed[1].alias("_last"))
    by_block = Window.partitionBy(*KEYS, "y").orderBy("_block")
    before = F.slice(F.reverse(F.flatten(F.collect_list("_last").over(by_block.rowsBetween(Window.unboundedPreceding, -1)))), 1, k)
    after = F.slice(F.flatten(F.collect_list("_first").over(by_block.rowsBetween(1, Window.unboundedFollowing))), 1, k)
    halo = ends.select(*own, F.concat(before, after).alias("_halo"))

    # Differences in the block and the halo: the k-th least of them, and the value that it leads to.
    sides = [side("value", j).over(up) for j in range(1, k + 1) for side in (F.lag, F.lead)]
    near = base.withColumn("_near", F.filter(F.array(*sides), lambda x: x.isNotNull())).join(halo, own)
    kth = F.least(F.lit(k), F.col("_c") - 1).cast("int")
    steps = F.array_sort(F.transform(F.concat("_near", "_halo"), lambda x: F.struct(F.abs(x - F.col("value")).alias("d"), x.alias("x"))))
    near = near.withColumn("_k", kth).withColumn("_at", F.element_at(steps, F.col("_k")))
    v, r, x = F.col("value"), F.col("_at")["d"], F.col("_at")["x"]
    low, high = F.when(x < v, x).otherwise(v - r), F.when(x > v, x).otherwise(v + r)
    # Of an open interval the values up to its lower end and under its upper one count; of a point those under and up to it.
    still = r == 0
    asked = F.array(F.struct(F.lit(1).alias("kind"), low.alias("at"), F.when(still, 0).otherwise(2).alias("rank")), F.struct(F.lit(2).alias("kind"), high.alias("at"), F.when(still, 2).otherwise(0).alias("rank")), F.struct(F.lit(0).alias("kind"), v.alias("at"), F.lit(1).alias("rank")))
    row = F.struct("y", "_block", "_i").alias("_row")
    spread = near.select(*KEYS, "_bounds", "_c", "_k", row, F.explode(asked).alias("e")).select(*KEYS, "_c", "_k", "_row", "e.*", block_of(F.col("e.at")).alias("_b"))
    value = (F.col("kind") == 0).cast("long")
    held = spread.groupBy(*KEYS, "_b").agg(F.sum(value).alias("_n"))
    held = held.select(*KEYS, "_b", F.coalesce(F.sum("_n").over(Window.partitionBy(*KEYS).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_under"))
    place = Window.partitionBy(*KEYS, "_b").orderBy("at", "rank").rowsBetween(Window.unboundedPreceding, 0)
    counted = spread.withColumn("_le", F.sum(value).over(place)).join(held, [*KEYS, "_b"]).withColumn("_le", F.col("_le") + F.col("_under"))
    by_row = counted.groupBy(*KEYS, "_row", "_c", "_k").agg((F.max(F.when(F.col("kind") == 2, F.col("_le"))) - F.max(F.when(F.col("kind") == 1, F.col("_le")))).alias("_m"))
    n = by_row.groupBy(*KEYS).agg(F.count("*").alias("_n"), F.avg(digamma(F.col("_c"))).alias("_dc"), F.avg(digamma(F.col("_m"))).alias("_dm"), F.avg(digamma(F.col("_k"))).alias("_dk"))
    return n.select(*KEYS, F.greatest(F.lit(0.0), digamma(F.col("_n")) + F.col("_dk") - F.col("_dc") - F.col("_dm")).alias("value"))


def screen_chi2(rows: DataFrame) -> DataFrame:
    """KEYS, value (chi-square of the levels of a categorical feature against the label), df, p."""
    found = chi_square(rows, KEYS, "value", "y")
    return found.select(*KEYS, F.col("statistic").alias("value"), "df", L.p_value(L.chi2_tail, F.col("statistic"), F.col("df")).alias("p"))


def digamma(n: Column) -> Column:
    """Of whole numbers from 1 on: the harmonic sum under 20, the asymptotic series from there."""
    x = n.cast("double")
    series = F.log(x) - 1 / (2 * x) - 1 / (12 * x * x) + 1 / (120 * x**4) - 1 / (252 * x**6)
    small = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(n, F.lit(20)).cast("int") - 1, F.lit(1))), F.lit(-0.5772156649015329), lambda a, i: a + 1 / i)
    return F.when(x >= 20, series).when(x > 1, small).otherwise(F.lit(-0.5772156649015329))


def passed(screen: DataFrame, rule: str, tasks: tuple[str, str] = ("O", "F")) -> DataFrame:
    """variant, feature, a, b, score: what a screen keeps in both tasks, with both values and their harmonic mean.
    Rules: p (at most MOST_P), r (absolute value at least LEAST_R), mi (at least LEAST_MI)."""
    tests = {"p": lambda: F.col("p") <= MOST_P, "r": lambda: F.abs("value") >= LEAST_R, "mi": lambda: F.col("value") >= LEAST_MI}
    of = lambda task: F.max(F.when(F.col("task") == task, F.col("value")))
    kept = screen.filter(tests[rule]()).groupBy("variant", "feature").agg(of(tasks[0]).alias("a"), of(tasks[1]).alias("b")).filter("a IS NOT NULL AND b IS NOT NULL")
    x, y = (F.abs("a"), F.abs("b")) if rule == "r" else (F.col("a"), F.col("b"))
    return kept.withColumn("score", F.when((x <= 0) | (y <= 0), 0.0).otherwise(2 * x * y / (x + y)))


def with_scores(screen: DataFrame, rule: str, tasks: tuple[str, str] = ("O", "F")) -> DataFrame:
    """The screen's rows with the ``score`` of those whose feature passes in both tasks (else null) and ``kept``: the rows of ``passed`` beside
    all others, the screen being worked out once."""
    tests = {"p": F.col("p") <= MOST_P if "p" in screen.columns else F.lit(False), "r": F.abs("value") >= LEAST_R, "mi": F.col("value") >= LEAST_MI}
    own = Window.partitionBy("variant", "feature")
    of = lambda task: F.max(F.when(tests[rule] & (F.col("task") == task), F.abs("value") if rule == "r" else F.col("value"))).over(own)
    both = screen.withColumn("_a", of(tasks[0])).withColumn("_b", of(tasks[1]))
    x, y = F.col("_a"), F.col("_b")
    score = F.when(x.isNotNull() & y.isNotNull(), F.when((x <= 0) | (y <= 0), 0.0).otherwise(2 * x * y / (x + y)))
    return both.withColumn("score", score).withColumn("kept", F.col("score").isNotNull()).drop("_a", "_b")
