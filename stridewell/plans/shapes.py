"""Queries of cleaning, reshaping and evaluation tables, on whole tables in their roles."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import evaluation as E
from ..operators import features as C
from ..operators import motion as M
from ..operators import segments as G
from ..sources import files
from ..sources.shared import folder, staged
from .frames import FEATURE_ROWS, FEATURES, PATH, PREDICTIONS, RECORDING, STRIDES, features, path, predictions, recording, table
from .motion import LOG, NEST, ORDERED, SPAN, rounded
from .studies import AB, CONF, METRIC_SQL, PK

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def add(name, body, sql=None, digits=5):
    QUERIES[name] = lambda spark, d: rounded(body(spark, d), digits)
    if sql:
        ORACLE_SQL[name] = sql


def missing(spark, d):
    """Features of which some lack values: a quarter of l_tax, a tenth of l_discount; one is NaN, one infinite."""
    f = features(spark, d)
    gone = ((F.col("feature") == "l_tax") & (F.col("pid") % 4 == 0)) | ((F.col("feature") == "l_discount") & (F.col("pid") % 10 == 0))
    return f.withColumn("value", F.when(~gone, F.col("value")))


MISSING = f"WITH {FEATURE_ROWS}, ms AS (SELECT pid, task, feature, y, CASE WHEN NOT (feature = 'l_tax' AND pid % 4 = 0 OR feature = 'l_discount' AND pid % 10 = 0) THEN value END AS value FROM feat)"
ODD = "CASE WHEN pid % 5 = 0 THEN 'NaN'::DOUBLE WHEN pid % 7 = 0 THEN 'Infinity'::DOUBLE WHEN pid % 11 = 0 THEN '-Infinity'::DOUBLE ELSE value END"


def odd(value):
    nan, inf = F.lit(float("nan")), F.lit(float("inf"))
    return F.when(F.col("pid") % 5 == 0, nan).when(F.col("pid") % 7 == 0, inf).when(F.col("pid") % 11 == 0, -inf).otherwise(value)


# -- cleaning -------------------------------------------------------------------------------------------------------------
columns = ["pid", "task", "feature", "value"]
add("flt_high_na", lambda s, d: C.keep_known(missing(s, d)).select(*columns), f"{MISSING} SELECT pid, task, feature, round(value, 5) AS value FROM ms WHERE feature IN (SELECT feature FROM ms GROUP BY feature HAVING avg((value IS NULL)::INT) <= 0.2)")
add("flt_variance", lambda s, d: C.keep_varying(features(s, d)).select(*columns), f"WITH {FEATURE_ROWS} SELECT pid, task, feature, round(value, 5) AS value FROM feat WHERE feature IN (SELECT feature FROM feat GROUP BY feature HAVING var_samp(value) >= 0.01)")
add("cln_median_impute", lambda s, d: C.impute_median(missing(s, d)).select(*columns), f"{MISSING}, m AS (SELECT feature, median(value) AS m FROM ms GROUP BY feature) SELECT pid, task, feature, round(coalesce(value, m), 5) AS value FROM ms JOIN m USING (feature)")
add("cln_standard_scale", lambda s, d: C.standard_scale(features(s, d)).select(*columns), f"WITH {FEATURE_ROWS} SELECT pid, task, feature, round((value - avg(value) OVER w) / stddev_pop(value) OVER w, 5) AS value FROM feat WINDOW w AS (PARTITION BY feature)")
add("cln_nan_to_num", lambda s, d: features(s, d).select("pid", "task", "feature", C.nan_to_num(odd(F.col("value"))).alias("value")), f"WITH {FEATURE_ROWS}, o AS (SELECT pid, task, feature, {ODD} AS v FROM feat) SELECT pid, task, feature, round(CASE WHEN isnan(v) THEN 0 WHEN v = 'Infinity' THEN 1.7976931348623157e308 WHEN v = '-Infinity' THEN -1.7976931348623157e308 ELSE v END, 5) AS value FROM o")
SCORE = "CASE WHEN pid % 3 = 0 THEN NULL WHEN pid % 5 = 0 THEN 'NaN'::DOUBLE ELSE value - 0.04 END"
add(
    "cln_onset_label",
    lambda s, d: features(s, d).select("pid", "task", "feature", C.onset_label(F.when(F.col("pid") % 3 == 0, F.lit(None).cast("double")).when(F.col("pid") % 5 == 0, float("nan")).otherwise(F.col("value") - 0.04)).alias("y")),
    f"WITH {FEATURE_ROWS}, o AS (SELECT pid, task, feature, {SCORE} AS s FROM feat) SELECT pid, task, feature, CASE WHEN s IS NOT NULL AND NOT isnan(s) AND s > 0 THEN 0 ELSE 1 END AS y FROM o",
)

# -- joins ----------------------------------------------------------------------------------------------------------------
WIDE = [("a", ("l_quantity", "l_tax"), "pid % 3 <> 0"), ("b", ("l_discount", "l_extendedprice"), "pid % 3 <> 1")]


def halves(spark, d):
    f = features(spark, d)
    return [f.filter(where).groupBy("pid", "task").pivot("feature", list(names)).agg(F.first("value")) for _, names, where in WIDE]


def outer(spark, d):
    a, b = halves(spark, d)
    return a.join(b, ["pid", "task"], "full_outer")


add("jn_outer_key", outer, f"WITH {FEATURE_ROWS} SELECT pid, task, round(l_quantity, 5) AS l_quantity, round(l_tax, 5) AS l_tax, round(l_discount, 5) AS l_discount, round(l_extendedprice, 5) AS l_extendedprice FROM (SELECT pid, task, l_quantity, l_tax FROM wide WHERE pid % 3 <> 0) FULL JOIN (SELECT pid, task, l_discount, l_extendedprice FROM wide WHERE pid % 3 <> 1) USING (pid, task)")
add("jn_anti_loo", lambda s, d: C.leave_out(features(s, d), 7).select(*columns), f"WITH {FEATURE_ROWS} SELECT pid, task, feature, round(value, 5) AS value FROM feat WHERE pid <> 7")

# -- reshaping ----------------------------------------------------------------------------------------------------------------
_nan = ", ".join(f"round(coalesce(max(CASE WHEN feature = '{c}' AND NOT (feature = 'l_tax' AND pid % 4 = 0) THEN value END), 'NaN'::DOUBLE), 5) AS {c}" for c in FEATURES)
add(
    "rsh_dict_to_table",
    lambda s, d: C.wide_table(features(s, d).filter("task = 'O' AND NOT (feature = 'l_tax' AND pid % 4 = 0)"), list(FEATURES)),
    f"WITH {FEATURE_ROWS} SELECT pid, {_nan} FROM feat WHERE task = 'O' GROUP BY pid",
)
add("rsh_task_suffix", lambda s, d: C.suffix_task(features(s, d).withColumn("value", F.when(F.col("pid") % 6 == 0, F.lit("n/a")).otherwise(F.round("value", 5).cast("string")))), f"WITH {FEATURE_ROWS} SELECT pid, feature || '_' || task AS feature, round(value, 5) AS value FROM feat WHERE pid % 6 <> 0")
NAMES = "SELECT DISTINCT o_orderstatus || '_' || c_mktsegment AS feature FROM orders JOIN customer ON o_custkey = c_custkey"


def names(spark, d):
    """Names made of a device and a motion token: statuses and segments of the orders."""
    joined = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return joined.select(F.concat_ws("_", "o_orderstatus", "c_mktsegment").alias("feature"), F.col("o_orderstatus").alias("device"), F.col("c_mktsegment").alias("motion")).distinct()


PICKS = [("O_BUILDING", ["O_"], ["BUILDING"]), ("F-P_MACHINERY", ["F_", "P_"], ["MACHINERY"]), ("O-F-P_AUTOMOBILE-HOUSEHOLD", ["O_", "F_", "P_"], ["AUTOMOBILE", "HOUSEHOLD"])]
_any = lambda tokens: "(" + " OR ".join(f"contains(feature, '{t}')" for t in tokens) + ")"
add("rsh_select_tokens", lambda s, d: C.select_tokens(names(s, d), PICKS), f"WITH nm AS ({NAMES}) " + " UNION ALL ".join(f"SELECT '{label}' AS label, feature FROM nm WHERE {_any(a)} AND {_any(b)}" for label, a, b in PICKS))
RULES = [("O_", "window_450_"), ("F_", "window_90_"), ("window_", "w")]
add("rsh_template", lambda s, d: names(s, d).select("feature", C.rewrite(F.col("feature"), RULES).alias("written")), f"WITH nm AS ({NAMES}) SELECT feature, replace(replace(replace(feature, 'O_', 'window_450_'), 'F_', 'window_90_'), 'window_', 'w') AS written FROM nm")
add(
    "rsh_meta_align",
    lambda s, d: features(s, d).select("pid", C.align_metadata(F.concat(F.when(F.col("task") == "O", "A").otherwise("B"), F.when(F.col("pid") % 2 == 0, "RW").otherwise(""), F.lit("-"), F.col("feature"))).alias("name"), F.when(F.col("feature").isin("l_tax", "l_discount"), "one-hot").otherwise("numeric").alias("kind"), "value"),
    f"WITH {FEATURE_ROWS} SELECT pid, 'X' || CASE WHEN pid % 2 = 0 THEN 'RW' ELSE '' END || '-' || feature AS name, CASE WHEN feature IN ('l_tax', 'l_discount') THEN 'one-hot' ELSE 'numeric' END AS kind, round(value, 5) AS value FROM feat",
)
_sets = lambda c: f"(SELECT array_to_string(list_filter(v, lambda x: (n >> (list_position(v, x) - 1)::BIGINT) & 1 = 1), '-') AS s, len(list_filter(v, lambda x: (n >> (list_position(v, x) - 1)::BIGINT) & 1 = 1)) AS k FROM (SELECT list_sort(list(DISTINCT {c})) AS v FROM nm) z, range(1, (1 << (SELECT count(DISTINCT {c}) FROM nm)::BIGINT)) r(n))"
add(
    "rsh_combos",
    lambda s, d: C.combinations(names(s, d), "device", "motion").select("label", F.size("devices").cast("long").alias("devices"), F.size("motions").cast("long").alias("motions")),
    f"WITH nm AS (SELECT DISTINCT o_orderstatus AS device, c_mktsegment AS motion FROM orders JOIN customer ON o_custkey = c_custkey) SELECT a.s || '_' || b.s AS label, a.k AS devices, b.k AS motions FROM {_sets('device')} a, {_sets('motion')} b",
)


def parsed(spark, d):
    found = C.combinations(names(spark, d), "device", "motion").select("label")
    a, b = C.parse_combo(F.col("label"), ["F", "O", "P"], ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"])
    return found.select("label", F.array_join(a, "+").alias("devices"), F.array_join(b, "+").alias("motions"))


add("rsh_parse_combo", parsed, f"WITH nm AS (SELECT DISTINCT o_orderstatus AS device, c_mktsegment AS motion FROM orders JOIN customer ON o_custkey = c_custkey) SELECT a.s || '_' || b.s AS label, replace(a.s, '-', '+') AS devices, replace(b.s, '-', '+') AS motions FROM {_sets('device')} a, {_sets('motion')} b")

# -- evaluation ---------------------------------------------------------------------------------------------------------------
METRICS = list(METRIC_SQL)


def crossed(p):
    """label, fold, and of every score the harmonic mean over both tasks."""
    return E.cross_all(E.metrics(E.confusion(p, PK), PK), ["label", "fold"], METRICS)


_ab = ", ".join(f"max(CASE WHEN task = '{t}' THEN {q} END) AS {t}_{m}" for m, q in METRIC_SQL.items() for t in "AB")
_harmonic = ", ".join(f"CASE WHEN A_{m} <= 0 OR B_{m} <= 0 THEN least(A_{m}, B_{m}) ELSE 2 * A_{m} * B_{m} / (A_{m} + B_{m}) END AS {m}" for m in METRICS)
CROSSED = f"WITH {PREDICTIONS}{CONF}, w AS (SELECT label, fold, {_ab} FROM cm GROUP BY ALL), h AS (SELECT label, fold, {_harmonic} FROM w)"
add("met_cross_task", lambda s, d: crossed(predictions(s, d)), f"{CROSSED} SELECT label, fold, {', '.join(f'round({m}, 5) AS {m}' for m in METRICS)} FROM h")
MATRIX = ("tn", "fp", "fn", "tp")


def fold_summary(p):
    """label; of every cross-task score the mean and deviation over folds; of every cell of the folds' matrices its sum, mean and deviation."""
    p = staged(p, "predictions")
    scores = crossed(p).groupBy("label").agg(*(x for m in METRICS for x in (F.avg(m).alias(f"{m}_mean"), F.stddev_pop(m).alias(f"{m}_std"))))
    cells = E.confusion(p, ["label", "fold"]).groupBy("label").agg(*(x for c in MATRIX for x in (F.sum(c).alias(c), F.avg(c).alias(f"{c}_mean"), F.stddev_pop(c).alias(f"{c}_std"))))
    return scores.join(cells, "label")


_of_scores = ", ".join(f"round(avg({m}), 5) AS {m}_mean, round(stddev_pop({m}), 5) AS {m}_std" for m in METRICS)
_of_cells = ", ".join(f"sum({c})::BIGINT AS {c}, round(avg({c}), 5) AS {c}_mean, round(stddev_pop({c}), 5) AS {c}_std" for c in MATRIX)
SUMMARY = f"{CROSSED}, fc AS (SELECT label, fold, {', '.join(f'sum({c}) AS {c}' for c in MATRIX)} FROM cm GROUP BY ALL), fs AS (SELECT label, {_of_cells} FROM fc GROUP BY label), hs AS (SELECT label, {_of_scores} FROM h GROUP BY label)"
add("met_fold_summary", lambda s, d: fold_summary(predictions(s, d)), f"{SUMMARY} SELECT * FROM hs JOIN fs USING (label)")
_best = ("accuracy", "balanced_accuracy", "f1", "mcc")
add(
    "res_score_table",
    lambda s, d: fold_summary(predictions(s, d)).select("label", *(f"{m}_{k}" for m in _best for k in ("mean", "std")), ((F.col("tn") + F.col("tp")) / (F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp"))).alias("accuracy")),
    f"{SUMMARY} SELECT label, {', '.join(f'{m}_{k}' for m in _best for k in ('mean', 'std'))}, round((tn + tp) / (tn + fp + fn + tp), 5) AS accuracy FROM hs JOIN fs USING (label)",
)
CELLS = {"tn": "tn + fp", "fp": "tn + fp", "fn": "tp + fn", "tp": "tp + fn"}


def normalised(p):
    """Cells over their class, and the harmonic mean of each cell over both tasks."""
    cells = E.confusion(p, PK).select(*PK, *(F.try_divide(F.col(c), F.expr(n)).alias(c) for c, n in CELLS.items()))
    return E.cross_all(cells, ["label", "fold"], list(CELLS))



_cells = ", ".join(f"max(CASE WHEN task = '{t}' THEN {c} / nullif({n}, 0) END) AS {t}_{c}" for c, n in CELLS.items() for t in "AB")
add("met_cm_norm", lambda s, d: normalised(predictions(s, d)), f"WITH {PREDICTIONS}{CONF}, w AS (SELECT label, fold, {_cells} FROM cm GROUP BY ALL) SELECT label, fold, " + ", ".join(f"round(CASE WHEN A_{c} <= 0 OR B_{c} <= 0 THEN least(A_{c}, B_{c}) ELSE 2 * A_{c} * B_{c} / (A_{c} + B_{c}) END, 5) AS {c}" for c in CELLS) + " FROM w")
def trial_rows(spark, d):
    """One row for each trial of results that hold a fold's persons, labels and predictions as arrays side by side."""
    part = F.pmod(F.xxhash64("pid", "task"), F.lit(64)).alias("_part")  # a result file holds a part of a fold
    nested = predictions(spark, d).groupBy("label", "fold", part).agg(F.collect_list(F.struct("pid", "task", "y", "yhat")).alias("t"))
    nested = nested.select("label", "fold", *(F.col(f"t.{c}").alias(c) for c in ("pid", "task", "y", "yhat")))
    return nested.select("label", "fold", F.explode(F.arrays_zip("pid", "task", "y", "yhat")).alias("z")).select("label", "fold", "z.*", (F.col("z.y") == F.col("z.yhat")).cast("int").alias("correct"))


add("res_trials", trial_rows, f"WITH {PREDICTIONS} SELECT label, fold, pid, task, y, yhat, (y = yhat)::INT AS correct FROM pred")

# -- sources and sinks ----------------------------------------------------------------------------------------------------------
def strides(spark, d):
    """Velocities at several strides in folders, joined again with the positions that they belong to."""
    out, p = folder(spark, "strides"), path(spark, d)
    parts = [M.velocity(p, ["pid"], "px", 2, stride=k).select("pid", "idx", "v", F.lit(k).alias("stride")) for k in STRIDES]
    for one in parts:
        one.write.mode("append").partitionBy("stride").parquet(out)
    return spark.read.parquet(out).join(p.select("pid", "idx", "px"), ["pid", "idx"], "full_outer").select("pid", "idx", F.col("stride").cast("int").alias("stride"), "v", "px")


_held = " UNION ALL ".join(f"SELECT pid, idx, {k} AS stride, first_value(v) OVER (PARTITION BY pid, s0 + ((idx - s0) // {k}) * {k} ORDER BY idx) AS v, px FROM an" for k in STRIDES)
add(
    "src_multi_stride",
    strides,
    f"""WITH {PATH}, cn AS (SELECT *, count(*) OVER (PARTITION BY pid) AS n FROM pt), vel AS (SELECT pid, idx, px, n, CASE WHEN idx < 2 THEN (lead(px, 2) OVER w - px) / (lead(t, 2) OVER w - t) WHEN idx >= n - 2 THEN (px - lag(px, 2) OVER w) / (t - lag(t, 2) OVER w)
  ELSE (lead(px, 2) OVER w - lag(px, 2) OVER w) / (lead(t, 2) OVER w - lag(t, 2) OVER w) END AS v FROM cn {ORDERED}),
an AS (SELECT *, CASE WHEN idx < 2 THEN 0 WHEN idx >= n - 2 THEN n - 2 ELSE 2 END AS s0 FROM vel WHERE n >= 4), hd AS ({_held})
SELECT pid, idx, stride, round(v, 5) AS v, round(px, 5) AS px FROM hd UNION ALL SELECT pid, idx, NULL, NULL, round(px, 5) FROM cn WHERE n < 4""",
)


def ranking(spark, d):
    out = folder(spark, "ranking")
    files.write_ranking(E.rank_pair(E.correlation(features(spark, d), ["task", "feature"], "value", "y", "r"), "r"), out, "score")
    return spark.read.schema("feature string, score double").option("header", True).csv(out)


add("snk_ranking", ranking, f"WITH {FEATURE_ROWS}, r AS (SELECT task, feature, abs(covar_pop(value, y) / nullif(stddev_pop(value) * stddev_pop(y), 0)) AS r FROM feat GROUP BY ALL) SELECT o.feature, round(CASE WHEN o.r <= 0 OR f.r <= 0 THEN 0 ELSE 2 * o.r * f.r / (o.r + f.r) END, 5) AS score FROM r o JOIN r f USING (feature) WHERE o.task = 'O' AND f.task = 'F' AND o.r IS NOT NULL AND f.r IS NOT NULL")


def metadata_csv(spark, d):
    """Customers as metadata: written as CSV with a header and read back with a schema."""
    out = folder(spark, "metadata")
    own = table(spark, d, "customer").select(F.col("c_custkey").alias("pid"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("score"))
    own.write.option("header", True).csv(out)
    return spark.read.schema("pid long, segment string, score double").option("header", True).csv(out)


add("src_metadata", metadata_csv, "SELECT c_custkey AS pid, c_mktsegment AS segment, round(c_acctbal, 5) AS score FROM customer")


def best_runs(spark, d):
    """The best fold of each label, written and read back."""
    out = folder(spark, "best")
    scores = E.cross_task(E.metrics(E.confusion(predictions(spark, d), PK), PK), ["label", "fold"], "mcc").withColumn("mcc", F.round("mcc", 9))
    files.best_run(scores, "label", "mcc").write.parquet(out)
    return spark.read.parquet(out)


add("snk_best_run", best_runs, f"WITH {PREDICTIONS}{AB}, k AS (SELECT label, fold, mcc, row_number() OVER (PARTITION BY label ORDER BY round(mcc, 9) DESC, fold) AS k FROM h) SELECT label, fold, round(mcc, 5) AS mcc FROM k WHERE k = 1")


def trial_files(spark, d):
    """Predictions nested by label and fold, as result files hold them, and their rows again."""
    out = folder(spark, "folds")
    nested = predictions(spark, d).withColumn("_part", F.pmod(F.xxhash64("pid", "task"), F.lit(64))).groupBy("label", "fold", "_part").agg(F.collect_list(F.struct("pid", "task", "y", "yhat")).alias("trials"))
    nested.write.partitionBy("label").parquet(out)
    return spark.read.parquet(out).select("label", "fold", F.explode("trials").alias("t")).select("label", "fold", "t.*")


add("src_fold_results", trial_files, f"WITH {PREDICTIONS} SELECT label, fold, pid, task, y, yhat FROM pred")

# -- segments -------------------------------------------------------------------------------------------------------------------
add(
    "seg_type",
    lambda s, d: G.nested(G.substep_log(recording(s, d)), G.stream(recording(s, d)), ["pid"], SPAN).select("pid", "kind", (F.row_number().over(Window.partitionBy("pid", "kind").orderBy("sub_id")) - 1).alias("place"), "sub_id", "ref_id", "start_idx", "end_idx"),
    f"WITH {RECORDING}{NEST} SELECT pid, kind, row_number() OVER (PARTITION BY pid, kind ORDER BY sub_id) - 1 AS place, sub_id, ref_id, start_idx, end_idx FROM nest",
)
add(
    "seg_tail",
    lambda s, d: G.tail_from_nearest(recording(s, d), SPAN).groupBy("pid").agg(F.count("*").alias("n"), F.min("idx").alias("first_idx")),
    f"""WITH {RECORDING}{LOG}, e AS (SELECT pid, max(event_t) AS e FROM lg GROUP BY pid), c AS (SELECT smp.pid, idx, row_number() OVER (PARTITION BY smp.pid ORDER BY abs(t - e), idx) AS k FROM smp JOIN e USING (pid)),
s AS (SELECT pid, idx AS first FROM c WHERE k = 1) SELECT pid, count(*) AS n, min(idx) AS first_idx FROM smp JOIN s USING (pid) WHERE idx >= first GROUP BY pid""",
)
