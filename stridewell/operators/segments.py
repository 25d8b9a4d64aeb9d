"""Segments of a recording from an event log, and joins by nearest time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .statistics import extremum
from .timeline import CHUNK_ROWS, CHUNK_SECONDS, carried

KEYS = ["pid"]


def event_log(rec: DataFrame, kind: str = "purchase") -> DataFrame:
    """pid, event_t, step: one row an event of ``kind``, numbered in order."""
    own = Window.partitionBy("pid").orderBy("idx")
    return rec.filter(F.col("kind") == kind).select("pid", F.col("t").alias("event_t"), (F.row_number().over(own) - 1).cast("long").alias("step"))


def samples(rec: DataFrame, kind: str = "purchase") -> DataFrame:
    return rec.filter(F.col("kind") != kind)


def stream(rec: DataFrame, kinds: tuple[str, ...] = ("purchase", "error")) -> DataFrame:
    """The recording without the rows of its log, numbered from 0."""
    own = Window.partitionBy("pid").orderBy("idx")
    return rec.filter(~F.col("kind").isin(*kinds)).withColumn("idx", (F.row_number().over(own) - 1).cast("long"))


def nearest(log: DataFrame, sampled: DataFrame, keys: list[str], span: float = CHUNK_SECONDS) -> DataFrame:
    """keys, step, event_t, idx of the sample nearest in time, the earlier one on ties.

    Both sides are laid on one time axis, in chunks of ``span``: the last sample at or before an event and the first one
    after it are carried to it, so there is no cross join and no session has to fit a task."""
    rows = sampled.select(*keys, F.col("t").alias("_t"), "idx", F.lit(None).cast("long").alias("step")).unionByName(
        log.select(*keys, F.col("event_t").alias("_t"), F.lit(None).cast("long").alias("idx"), "step")
    )
    order = [F.col("_t"), F.col("idx").isNull().cast("int"), F.col("idx")]
    rows = rows.withColumn("_chunk", F.floor(F.col("_t") / span).cast("long"))
    # Of several samples of one time the first stands for all.
    repeated = F.lag(F.when(F.col("idx").isNotNull(), F.col("_t"))).over(Window.partitionBy(*keys, "_chunk").orderBy(*order)) == F.col("_t")
    rows = rows.withColumn("_rep", F.coalesce(repeated, F.lit(False)))
    sample = F.when(F.col("idx").isNotNull() & ~F.col("_rep"), F.struct(F.col("_t").alias("t"), F.col("idx").alias("i")))
    found = carried(rows, keys, order, None, sample).filter("step IS NOT NULL")
    b, a = F.col("_before"), F.col("_after")
    earlier = a.isNull() | (F.col("_t") - b["t"] <= a["t"] - F.col("_t"))
    return found.select(*keys, "step", F.col("_t").alias("event_t"), F.when(b.isNotNull() & earlier, b["i"]).otherwise(a["i"]).alias("idx"))


def steps(rec: DataFrame, span: float = CHUNK_SECONDS) -> DataFrame:
    """pid, step, start_idx, end_idx: half open, from the nearest sample of the event before to that of its own."""
    sampled = samples(rec)
    near = nearest(event_log(rec), sampled, KEYS, span)
    first = sampled.groupBy("pid").agg(F.min("idx").alias("_first"))
    own = Window.partitionBy("pid").orderBy("step")
    return near.join(first, "pid").select("pid", "step", F.coalesce(F.lag("idx").over(own), F.col("_first")).alias("start_idx"), F.col("idx").alias("end_idx"))


def interval(sampled: DataFrame, segs: DataFrame, keys: list[str]) -> DataFrame:
    """Samples with the segment that holds them, [start_idx, end_idx). Segments follow each other without overlap, so
    starts and samples are laid on one axis and each sample takes the last start before it: a sort by key instead
    of every sample with every segment. Segments without a sample take no part in the axis."""
    held = segs.filter(F.col("start_idx") < F.col("end_idx"))
    names = [c for c in segs.columns if c not in keys]
    starts = held.select(*keys, F.col("start_idx").alias("_at"), F.struct(*names).alias("_seg"), F.lit(None).cast(sampled.select(F.struct(*sampled.columns)).schema[0].dataType).alias("_row"))
    rows = sampled.select(*keys, F.col("idx").alias("_at"), F.lit(None).cast(starts.schema["_seg"].dataType).alias("_seg"), F.struct(*sampled.columns).alias("_row"))
    order = [F.col("_at"), F.col("_row").isNotNull().cast("int")]
    laid = carried(starts.unionByName(rows), keys, order, F.col("_at") / CHUNK_ROWS, F.col("_seg"), ahead=False).withColumnRenamed("_before", "_in").filter("_row IS NOT NULL")
    return laid.filter(F.col("_row.idx") < F.col("_in.end_idx")).select(*(F.col("_row")[c].alias(c) for c in sampled.columns), *(F.col("_in")[c].alias(c) for c in names))


def substep_log(rec: DataFrame, ends: str = "purchase", within: tuple[str, ...] = ("error",)) -> DataFrame:
    """pid, event_t, step, sub, kind, row: the rows of a log in order, an event of ``ends`` being the last of its step."""
    own = Window.partitionBy("pid").orderBy("idx")
    rows = rec.filter(F.col("kind").isin(ends, *within)).withColumn("_end", (F.col("kind") == ends).cast("long"))
    step = F.coalesce(F.sum("_end").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = rows.select("pid", F.col("t").alias("event_t"), step.alias("number"), "kind", "idx")
    sub = F.row_number().over(Window.partitionBy("pid", "number").orderBy("idx")) - 1
    return numbered.select("pid", "event_t", F.col("number").alias("step"), sub.cast("long").alias("sub"), "kind", (F.row_number().over(own) - 1).cast("long").alias("row"))


def log_rows(log: DataFrame, keys: list[str]) -> DataFrame:
    """A log with columns step, kind, event_t and row (its order in the session) as ``substep_log`` makes one: sub counts the rows of
    a step, sub_id those of the session in order of step and row; ref_id numbers a substep by the
    rows of its own step times the step plus sub, which names two alike unless all steps have equally many rows."""
    step = Window.partitionBy(*keys, "step")
    sub = F.row_number().over(step.orderBy("row")) - 1
    sub_id = F.row_number().over(Window.partitionBy(*keys).orderBy("step", "row")) - 1
    made = log.select(*keys, "step", "kind", "event_t", "row", sub.cast("long").alias("sub"), sub_id.cast("long").alias("sub_id"), F.count("*").over(step).alias("_n"))
    return made.withColumn("ref_id", F.col("_n") * F.col("step") + F.col("sub")).drop("_n")


def nested(log: DataFrame, sampled: DataFrame, keys: list[str], span: float = CHUNK_SECONDS) -> DataFrame:
    """keys, step, sub, sub_id, ref_id, kind, event_t, step_start, step_end, start_idx, end_idx: the two levels of segments of a log,
    half open places of samples. A step goes from the sample nearest to the last time of the step before (the session's
    first sample for the first one) to that nearest to its own last time. A substep goes from the nearest sample of the
    row before it to that of its own row, both sought inside the step, so the step's last substep ends with the step's
    last sample. A step without samples has empty substeps."""
    rows = log_rows(log, keys)
    near = nearest(rows.select(*keys, "event_t", F.col("row").alias("step")), sampled, keys, span).select(*keys, F.col("step").alias("row"), F.col("idx").alias("_at"))
    first = sampled.groupBy(*keys).agg(F.min("idx").alias("_first"))
    latest = rows.groupBy(*keys, "step").agg(F.max_by("row", F.struct("event_t", -F.col("row"))).alias("row"))
    ends = latest.join(near, [*keys, "row"]).join(first, keys)
    own = Window.partitionBy(*keys).orderBy("step")
    ends = ends.select(*keys, "step", F.coalesce(F.lag("_at").over(own), F.col("_first")).alias("step_start"), F.col("_at").alias("step_end"))
    placed = rows.join(near, [*keys, "row"]).join(ends, [*keys, "step"])
    inside = lambda c: F.when(F.col("step_start") >= F.col("step_end"), F.col("step_start")).otherwise(F.least(F.greatest(c, F.col("step_start")), F.col("step_end") - 1))
    before = F.coalesce(F.lag("_at").over(Window.partitionBy(*keys, "step").orderBy("row")), F.col("step_start"))
    return placed.select(*keys, "step", "sub", "sub_id", "ref_id", "kind", "event_t", "step_start", "step_end", inside(before).alias("start_idx"), inside(F.col("_at")).alias("end_idx"))


def level(found: DataFrame, keys: list[str], name: str) -> DataFrame:
    """keys, segment, start_idx, end_idx of one level of ``nested``: step or substep (by sub_id)."""
    if name == "step":
        return found.select(*keys, F.col("step").alias("segment"), F.col("step_start").alias("start_idx"), F.col("step_end").alias("end_idx")).distinct()
    return found.select(*keys, F.col("sub_id").alias("segment"), "start_idx", "end_idx")


def tail_from_nearest(rec: DataFrame, span: float = CHUNK_SECONDS) -> DataFrame:
    """Samples from the one nearest to the last event on."""
    last = event_log(rec).groupBy("pid").agg(F.max("event_t").alias("event_t"), F.max("step").alias("step"))
    start = nearest(last, samples(rec), KEYS, span).select("pid", F.col("idx").alias("_start"))
    return samples(rec).join(start, "pid").filter(F.col("idx") >= F.col("_start")).drop("_start")


def event_at_extremum(rec: DataFrame, log: DataFrame) -> DataFrame:
    """pid, side, extreme_t, step, substep (the row of the log) and kind of the event nearest to the session's largest and smallest value,
    the earlier row on ties."""
    ends = extremum(rec, KEYS)
    times = ends.select("pid", F.explode(F.array(F.struct(F.lit("max").alias("side"), F.col("max_t").alias("t")), F.struct(F.lit("min").alias("side"), F.col("min_t").alias("t")))).alias("e")).select("pid", "e.side", F.col("e.t").alias("extreme_t"))
    near = F.min_by(F.struct("step", F.col("row").alias("substep"), "kind"), F.struct(F.abs(F.col("event_t") - F.col("extreme_t")), "row")).alias("n")
    return times.join(log, "pid").groupBy("pid", "side", "extreme_t").agg(near).select("pid", "side", "extreme_t", "n.*")


def type_code(kind: Column, names: tuple[str, ...]) -> Column:
    """Place of a type among ``names``; any other type raises."""
    code = F.when(kind == names[0], 0)
    for k, n in enumerate(names[1:], 1):
        code = code.when(kind == n, k)
    return code.otherwise(F.raise_error(F.concat(F.lit("unknown type "), kind)).cast("int"))
