"""Values carried along a time axis that may be too long for one task.

A session is cut into chunks of its axis. Within a chunk ordered windows find the last known value at or before each row
and the next one at or after it; each chunk is summed up by its first and last known value; windows over those few rows
say what reaches a chunk from outside. So a session of any length is spread over many tasks, and the work is that of two
sorts. No window looks ahead without an end: Spark would begin such a frame anew for every row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Places of a chunk where the axis is a sample's place, and seconds where it is time.
CHUNK_ROWS, CHUNK_SECONDS = 65_536, 600.0


def same_keys(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    """Equal keys, where null equals null."""
    found = a[keys[0]].eqNullSafe(b[keys[0]])
    for k in keys[1:]:
        found = found & a[k].eqNullSafe(b[k])
    return found


def carried_all(df: DataFrame, keys: list[str], order: list[Column], chunk: Column | None, values: dict[str, Column], ahead: bool = True) -> DataFrame:
    """``df`` with ``_before_<name>`` of each of ``values``, its last value that is not null at or before each row in that order, and with
    ``ahead`` also ``_after_<name>``, the first one at or after it. Without ``chunk`` the rows have their column _chunk
    already. All values are carried by the same sorts and one join with the chunks' ends; ``df`` is read twice."""
    own, names = [*keys, "_chunk"], list(values)
    base = df if chunk is None else df.withColumn("_chunk", F.floor(chunk).cast("long"))
    base = base.withColumns({f"_value_{n}": v for n, v in values.items()})
    back = Window.partitionBy(*own).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    front = Window.partitionBy(*own).orderBy(*(c.desc() for c in order)).rowsBetween(Window.unboundedPreceding, 0)
    place = {n: F.when(F.col(f"_value_{n}").isNotNull(), F.struct(*order)) for n in names}
    ends = base.groupBy(*own).agg(*(e(f"_value_{n}", place[n]).alias(f"{end}_{n}") for n in names for e, end in ((F.min_by, "_first"), (F.max_by, "_last"))))
    earlier = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy(*keys).orderBy(F.desc("_chunk")).rowsBetween(Window.unboundedPreceding, -1)
    reach = [F.last(f"_last_{n}", ignorenulls=True).over(earlier).alias(f"_in_{n}") for n in names]
    if ahead:
        reach += [F.last(f"_first_{n}", ignorenulls=True).over(later).alias(f"_out_{n}") for n in names]
    outside = ends.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(own)), *reach)
    seen = base.withColumns({f"_before_{n}": F.last(f"_value_{n}", ignorenulls=True).over(back) for n in names})
    if ahead:
        seen = seen.withColumns({f"_after_{n}": F.last(f"_value_{n}", ignorenulls=True).over(front) for n in names})
    there = F.lit(True)
    for i, k in enumerate(own):
        there = there & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    filled = {f"_before_{n}": F.coalesce(f"_before_{n}", f"_in_{n}") for n in names}
    if ahead:
        filled |= {f"_after_{n}": F.coalesce(f"_after_{n}", f"_out_{n}") for n in names}
    gone = [*(f"_k{i}" for i in range(len(own))), "_chunk", *(f"{x}_{n}" for n in names for x in ("_value", "_in", "_out"))]
    return seen.join(outside, there).withColumns(filled).drop(*gone)


def carried(df: DataFrame, keys: list[str], order: list[Column], chunk: Column | None, value: Column, ahead: bool = True) -> DataFrame:
    """``carried_all`` of a single value, as ``_before`` and ``_after``."""
    found = carried_all(df, keys, order, chunk, {"v": value}, ahead).withColumnRenamed("_before_v", "_before")
    return found.withColumnRenamed("_after_v", "_after") if ahead else found


def numbered(df: DataFrame, keys: list[str], order: list[Column], chunk: Column, out: str = "idx") -> DataFrame:
    """``df`` with ``out``, each row's place in its session from 0: the rows of earlier chunks and the place in its own."""
    own = [*keys, "_chunk"]
    base = df.withColumn("_chunk", F.floor(chunk).cast("long"))
    counts = base.groupBy(*own).agg(F.count("*").alias("_c"))
    before = F.sum("_c").over(Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(*own, F.coalesce(before, F.lit(0)).alias("_off")).toDF(*(f"_k{i}" for i in range(len(own))), "_off")
    there = F.lit(True)
    for i, k in enumerate(own):
        there = there & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    placed = base.withColumn("_at", F.row_number().over(Window.partitionBy(*own).orderBy(*order)) - 1).join(counts, there)
    return placed.withColumn(out, (F.col("_off") + F.col("_at")).cast("long")).drop(*(f"_k{i}" for i in range(len(own))), "_off", "_at", "_chunk")
