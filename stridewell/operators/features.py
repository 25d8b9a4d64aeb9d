"""Cleaning, reshaping and choosing of features in long form: pid, task, feature, value."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Shares and variances of the filters, and the largest finite double.
MOST_MISSING, LEAST_VARIANCE = 0.2, 0.01
LARGEST = 1.7976931348623157e308


def keep_known(rows: DataFrame, most: float = MOST_MISSING) -> DataFrame:
    """Rows of the features with at most a share ``most`` of missing values."""
    kept = rows.groupBy("feature").agg(F.avg(F.col("value").isNull().cast("double")).alias("_na")).filter(F.col("_na") <= most)
    return rows.join(kept.select("feature"), "feature", "left_semi")


def keep_varying(rows: DataFrame, least: float = LEAST_VARIANCE) -> DataFrame:
    """Rows of the features with a sample variance of at least ``least``; without one they go."""
    kept = rows.groupBy("feature").agg(F.var_samp("value").alias("_v")).filter(F.col("_v") >= least)
    return rows.join(kept.select("feature"), "feature", "left_semi")


def impute_median(rows: DataFrame) -> DataFrame:
    """Missing values filled with the feature's median: one row a feature meets the rows again."""
    middle = rows.groupBy("feature").agg(F.median("value").alias("_m"))
    return rows.join(middle, "feature").withColumn("value", F.coalesce("value", "_m")).drop("_m")


def standard_scale(rows: DataFrame) -> DataFrame:
    """Values as z-scores of their feature, population deviation; constant features by 1."""
    fit = rows.groupBy("feature").agg(F.avg("value").alias("_m"), F.stddev_pop("value").alias("_s"))
    z = (F.col("value") - F.col("_m")) / F.when(F.col("_s") > 0, F.col("_s")).otherwise(1.0)
    return rows.join(fit, "feature").withColumn("value", z).drop("_m", "_s")


def nan_to_num(c: Column) -> Column:
    """NaN as 0, infinities as the largest finite numbers of their sign; null stays."""
    return F.when(F.isnan(c), 0.0).when(c == float("inf"), LARGEST).when(c == float("-inf"), -LARGEST).otherwise(c)


def onset_label(score: Column) -> Column:
    """0 for a positive score, else 1, also where it is missing or NaN."""
    return F.when(~F.isnan(score) & (score > 0), 0).otherwise(1)


def leave_out(rows: DataFrame, pid: int) -> DataFrame:
    return rows.filter(~F.col("pid").eqNullSafe(F.lit(pid)))


def wide_table(rows: DataFrame, names: list[str]) -> DataFrame:
    """pid and a column for each name, NaN where a person lacks it."""
    wide = rows.groupBy("pid").pivot("feature", names).agg(F.first("value"))
    return wide.select("pid", *(F.coalesce(F.col(c), F.lit(float("nan"))).alias(c) for c in names))


def suffix_task(rows: DataFrame) -> DataFrame:
    """Names with their task, values as numbers; what is no number is left out."""
    number = F.col("value").cast("string").try_cast("double")
    return rows.select("pid", F.concat_ws("_", "feature", "task").alias("feature"), number.alias("value")).filter("value IS NOT NULL")


def select_tokens(names: DataFrame, combos: list[tuple[str, list[str], list[str]]]) -> DataFrame:
    """label, feature: the names that hold one of a combination's devices and one of its motions."""
    holds = lambda tokens: reduce(lambda a, b: a | b, (F.col("feature").contains(t) for t in tokens))
    chosen = F.filter(F.array(*(F.when(holds(d) & holds(m), F.lit(label)) for label, d, m in combos)), lambda x: x.isNotNull())
    return names.select(F.explode(chosen).alias("label"), "feature")


def rewrite(name: Column, rules: list[tuple[str, str]]) -> Column:
    """Plain replacements, one after the other."""
    return reduce(lambda c, rule: F.replace(c, F.lit(rule[0]), F.lit(rule[1])), rules, name)


def align_metadata(name: Column) -> Column:
    """A-, B- as X- and ARW-, BRW- as XRW-."""
    return F.regexp_replace(name, "^[AB](RW)?-", "X$1-")


def subsets(df: DataFrame, column: str) -> DataFrame:
    """set: every subset but the empty one of a column's distinct values, which are few, by the bits of a number."""
    values = df.agg(F.array_sort(F.collect_set(column)).alias("v"))
    numbers = values.select("v", F.explode(F.sequence(F.lit(1).cast("long"), F.expr("shiftleft(1L, size(v)) - 1"))).alias("n"))
    return numbers.select(F.filter("v", lambda x, i: F.call_function("getbit", F.col("n"), i) == 1).alias("set"))


def combinations(df: DataFrame, devices: str, motions: str) -> DataFrame:
    """label, devices, motions: all subsets of devices with all subsets of motions."""
    left, right = subsets(df, devices).withColumnRenamed("set", "devices"), subsets(df, motions).withColumnRenamed("set", "motions")
    return left.join(F.broadcast(right), F.lit(True)).select(F.concat_ws("_", F.array_join("devices", "-"), F.array_join("motions", "-")).alias("label"), "devices", "motions")


def parse_combo(label: Column, devices: list[str], motions: list[str]) -> tuple[Column, Column]:
    """The devices and the motions that a label names; a part that is neither raises."""
    parts = F.split(label, "[_-]")
    known = F.forall(parts, lambda p: p.isin(*devices, *motions))
    error = F.raise_error(F.concat(F.lit("unknown part in "), label))
    of = lambda names: F.when(known, F.filter(parts, lambda p: p.isin(*names))).otherwise(error)
    return of(devices), of(motions)
