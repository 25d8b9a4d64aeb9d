"""Cleaning of recordings and resampling onto a uniform grid."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import staged
from .timeline import CHUNK_ROWS, carried_all, numbered


#: Rows of a grid that a task sorts in memory.
TASK_ROWS = 1_000_000


def drop_columns(df: DataFrame, token: str) -> DataFrame:
    return df.select(*(c for c in df.columns if token not in c))


def keep_columns(df: DataFrame, tokens: list[str], always: tuple[str, ...] = ()) -> DataFrame:
    """Columns whose name holds one of the tokens, and those of ``always``."""
    return df.select(*(c for c in df.columns if c in always or any(t in c for t in tokens)))


def truncate_start(df: DataFrame, keys: list[str], *pressed: Column) -> DataFrame:
    """Rows from the first sample on at which either hand is pressed, numbered from 0 again; a hand that never is does not
    count, and a session without any has no rows."""
    firsts = [F.min(F.when(p, F.col("idx"))).over(Window.partitionBy(*keys)) for p in pressed]
    first = F.least(*firsts) if len(firsts) > 1 else firsts[0]
    return df.withColumn("_first", first).filter(F.col("idx") >= F.col("_first")).withColumn("idx", F.col("idx") - F.col("_first")).drop("_first")


def dedup_time(df: DataFrame, keys: list[str]) -> DataFrame:
    """The first row of each timestamp, numbered from 0 again."""
    own = Window.partitionBy(*keys, "t").orderBy("idx")
    kept = df.withColumn("_k", F.row_number().over(own)).filter("_k = 1").drop("_k").withColumnRenamed("idx", "_old")
    return numbered(kept, keys, [F.col("_old")], F.col("_old") / CHUNK_ROWS).drop("_old").select(*df.columns)


def last_place(a: Column, b: Column, step: float) -> Column:
    """The last place of a grid from ``a`` on that reaches ``b``. A span of whole steps ends on its last sample, also where the
    quotient is off by its last bits."""
    return F.greatest(F.ceil((b - a) / step - 1e-9), F.lit(0))


def grid(df: DataFrame, keys: list[str], step: float) -> DataFrame:
    """keys, k, t: times from a session's first sample on, ``step`` apart, up to the first one at or after its last sample. Sessions
    are few and small rows, so stretches of their places are dealt to tasks before they are spread out."""
    ends = df.groupBy(*keys).agg(F.min("t").alias("_a"), F.max("t").alias("_b")).withColumn("_last", last_place(F.col("_a"), F.col("_b"), step))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = ends.select(*keys, "_a", "_last", F.explode(F.sequence(F.lit(0).cast("long"), "_last", F.lit(CHUNK_ROWS).cast("long"))).alias("_from")).repartition(parts, *keys, "_from")
    spread = dealt.select(*keys, "_a", F.explode(F.sequence("_from", F.least(F.col("_from") + CHUNK_ROWS - 1, F.col("_last")))).alias("k"))
    return spread.select(*keys, "k", (F.col("_a") + F.col("k") * step).alias("t"))


def filled_grid(df: DataFrame, keys: list[str], step: float, unit: float = 0.001, columns: tuple[str, ...] = (), order: tuple[str, ...] = ()) -> DataFrame:
    """``left_join_grid``, and nulls of ``columns`` between two samples filled on the straight line by the row's place, rows of a place in
    the order of ``order``. A sample finds its places from its own time; what lies up to the next sample is worked out at
    the sample and spread out last. So only samples are dealt and sorted, once by session, and never the grid."""
    whole = lambda t: F.round(t / unit).cast("long")
    snapped = (lambda t: whole(t) / round(1 / unit)) if unit < 1 else (lambda t: whole(t) * F.lit(float(unit)))
    others = [c for c in df.columns if c not in (*keys, "t")]
    every = Window.partitionBy(*keys)
    base = df.withColumn("_a", F.min("t").over(every)).withColumn("_last", last_place(F.col("_a"), F.max("t").over(every), step)).withColumn("_w", whole(F.col("t")))
    # The places around a sample's time that can round to it; the equality below decides.
    low = F.greatest(F.floor(((F.col("_w") - 0.5) * unit - F.col("_a")) / step) - 1, F.lit(0))
    high = F.least(F.ceil(((F.col("_w") + 0.5) * unit - F.col("_a")) / step) + 1, F.col("_last"))
    near = base.withColumn("k", F.explode(F.when(low <= high, F.sequence(low, high)))).filter(whole(F.col("_a") + F.col("k") * step) == F.col("_w"))
    by = [F.col("k"), *(F.col(c) for c in order)]
    own = Window.partitionBy(*keys).orderBy(*by)
    so_far = own.rowsBetween(Window.unboundedPreceding, 0)
    later = Window.partitionBy(*keys).orderBy(*(c.desc() for c in by)).rowsBetween(Window.unboundedPreceding, -1)
    placed = near.withColumn("_same", F.coalesce((F.lag("k").over(own) == F.col("k")).cast("long"), F.lit(0).cast("long"))).withColumn("_next", F.lead("k").over(own))
    if columns:
        placed = placed.withColumn("_more", F.sum("_same").over(so_far))
        known = {c: F.when(F.col(c).isNotNull(), F.struct((F.col("k") + F.col("_more")).alias("p"), F.col(c).alias("x"))) for c in columns}
        placed = placed.withColumns({f"_known_{c}": v for c, v in known.items()})
        placed = placed.withColumns({f"_before_{c}": F.last(f"_known_{c}", ignorenulls=True).over(so_far) for c in columns})
        placed = placed.withColumns({f"_after_{c}": F.last(f"_known_{c}", ignorenulls=True).over(later) for c in columns})
    upto = F.greatest(F.coalesce(F.col("_next"), F.col("_last") + 1) - 1, F.col("k"))
    spread = placed.withColumn("_at", F.explode(F.sequence("k", upto)))

    def value(c: str) -> Column:
        own_row = F.when(F.col("_at") == F.col("k"), F.col(c))
        if c not in columns:
            return own_row.alias(c)
        a, b, here = F.col(f"_before_{c}"), F.col(f"_after_{c}"), F.col("_at") + F.col("_more")
        between = a["x"] + (b["x"] - a["x"]) * (here - a["p"]) / (b["p"] - a["p"])
        return F.when(own_row.isNotNull(), own_row).when(a.isNotNull() & b.isNotNull(), between).alias(c)

    return spread.select(*keys, F.col("_at").alias("k"), snapped(F.col("_a") + F.col("_at") * step).alias("t"), *map(value, others))


def left_join_grid(df: DataFrame, keys: list[str], step: float, unit: float = 0.001) -> DataFrame:
    """keys, k, t and the samples' columns: the grid with all samples whose time, in whole ``unit``s, equals that of a place. A
    place that several samples share has a row for each, one that none has holds nulls; t is the rounded time."""
    return filled_grid(df, keys, step, unit)


def interpolate(df: DataFrame, keys: list[str], columns: tuple[str, ...] = ("x",), order: tuple[str, ...] = ("k",)) -> DataFrame:
    """Nulls between two samples filled on the straight line by the row's place; none beyond the ends. A session is spread
    over chunks of its first order column. All columns are filled at once, from a written table of the numbered rows, so the
    plan does not grow with their number."""
    by = [F.col(c) for c in order]
    placed = staged(numbered(df, keys, by, by[0] / CHUNK_ROWS, "_place"), "places")
    here = F.col("_place")
    known = {c: F.when(F.col(c).isNotNull(), F.struct(here.alias("p"), F.col(c).alias("x"))) for c in columns}
    near = carried_all(placed, keys, [here], here / CHUNK_ROWS, known)

    def filled(c: str) -> Column:
        a, b = F.col(f"_before_{c}"), F.col(f"_after_{c}")
        between = a["x"] + (b["x"] - a["x"]) * (here - a["p"]) / (b["p"] - a["p"])
        return F.when(F.col(c).isNotNull(), F.col(c)).when(a.isNotNull() & b.isNotNull(), between).alias(c)

    return near.select(*(filled(c) if c in columns else F.col(c) for c in df.columns))


def resampled(df: DataFrame, keys: list[str], step: float, columns: tuple[str, ...], unit: float = 0.001, digits: int = 6) -> DataFrame:
    """keys, idx, t and ``columns`` on a uniform grid: samples joined by equal rounded times, gaps filled on straight lines, values
    rounded, rows that still lack a value left out, the rest numbered from 0. The samples are written once and dealt by
    session to as many tasks as the grid's rows need; the grid is made, numbered and read on where they are."""
    sampled = staged(df.select(*keys, "idx", "t", *columns), "samples")
    ends = sampled.groupBy(*keys).agg((last_place(F.min("t"), F.max("t"), step) + 1).alias("_n"))
    rows = ends.agg(F.sum("_n")).first()[0] or 0
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows / TASK_ROWS))
    filled = filled_grid(sampled.repartition(parts, *keys), keys, step, unit, columns, ("idx",))
    whole = filled.select(*keys, "k", F.col("idx").alias("_old"), "t", *(F.round(c, digits).alias(c) for c in columns)).na.drop(subset=list(columns))
    place = (F.row_number().over(Window.partitionBy(*keys).orderBy("k", "_old")) - 1).cast("long")
    return whole.withColumn("idx", place).select(*keys, "idx", "t", *columns)
