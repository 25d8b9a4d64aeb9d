"""Queries over fitted models and their selection, and round trips of sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import models as L
from ..operators import search as N
from ..operators import wide as W
from ..sources import files as S
from ..sources.shared import folder, staged
from .frames import FEATURE_ROWS, FEATURES, RECORDING, STRIDES, features, recording, spread, strided
from .motion import rounded

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def wide(spark, d):
    f = features(spark, d)
    return f.groupBy("pid", "task", "y").pivot("feature", list(FEATURES)).agg(F.first("value"))


def trip_csv(spark, d):
    out, rec = folder(spark, "csv"), recording(spark, d).select("pid", "idx", F.round("t", 3).alias("t"), "x")
    S.write_by_key(rec, out, ["pid"], "idx")
    return rounded(S.read_tracking(spark, out, "idx long, t double, x double").select(F.col("pid").cast("long").alias("pid"), "idx", "t", "x"), 4)


QUERIES["snk_csv"] = trip_csv
ORACLE_SQL["snk_csv"] = f"WITH {RECORDING} SELECT pid, idx, round(t, 3) AS t, round(x, 3) AS x FROM rec"


def trip_tracking(spark, d):
    """Recordings in files whose names hold task and person, A_7.csv; both come back from the names alone."""
    out, rec = folder(spark, "tracking"), recording(spark, d)
    task = F.when(F.col("pid") % 2 == 0, "A").otherwise("B")
    named = rec.select(F.concat_ws("_", task, F.concat("pid", F.lit(".csv"))).alias("file"), F.col("idx").alias("_idx"), F.round("t", 3).alias("Timestamp"), "x")
    S.write_files(named, out, ["file"], "_idx", lambda file: file[0])
    return rounded(S.read_named(spark, out, "Timestamp double, x double").select(F.col("pid").cast("long").alias("pid"), "task_id", F.col("Timestamp").alias("t"), "x"), 4)


QUERIES["src_tracking"] = trip_tracking
ORACLE_SQL["src_tracking"] = f"WITH {RECORDING} SELECT pid, CASE WHEN pid % 2 = 0 THEN 'A' ELSE 'B' END AS task_id, round(t, 3) AS t, round(x, 3) AS x FROM rec"


def trip_log(spark, d):
    """The event log, and with it the recording of the same person: how many samples come before each event."""
    out, rec = folder(spark, "log"), recording(spark, d)
    own = Window.partitionBy("pid").orderBy("idx")
    log = rec.filter("kind = 'purchase'").select("pid", F.round("t", 3).alias("Timestamp"), (F.row_number().over(own) - 1).alias("step"), F.col("kind").alias("subStep"))
    S.write_by_key(log, out, ["pid"], "step")
    found = S.read_log(spark, out).select(F.col("pid").cast("long").alias("pid"), "Timestamp", "step", F.col("subStep").alias("kind"))
    samples = rec.filter("kind <> 'purchase'").groupBy("pid").agg(F.count("*").alias("samples"))
    return rounded(found.join(samples, "pid"), 4)


QUERIES["src_assembly"] = trip_log
ORACLE_SQL["src_assembly"] = f"""WITH {RECORDING}, n AS (SELECT pid, count(*) AS samples FROM rec WHERE kind <> 'purchase' GROUP BY pid)
SELECT pid, round(t, 3) AS "Timestamp", (row_number() OVER (PARTITION BY pid ORDER BY idx) - 1)::INT AS step, kind, samples FROM rec JOIN n USING (pid) WHERE kind = 'purchase'"""


def trip_batches(spark, d):
    f, out = features(spark, d), [folder(spark, "batch") for _ in range(2)]
    f.filter("task = 'O'").select("pid", "feature", F.lit(1).alias("a")).write.parquet(out[0])
    f.filter("task = 'F'").select("pid", "feature").write.parquet(out[1])
    return S.read_batches(spark, out).select("pid", "feature", F.coalesce("a", F.lit(0)).alias("a"))


QUERIES["src_batches"] = trip_batches
ORACLE_SQL["src_batches"] = f"WITH {FEATURE_ROWS} SELECT pid, feature, CASE WHEN task = 'O' THEN 1 ELSE 0 END AS a FROM feat"


def labelled_features(spark, d):
    """label, feature: the features of each task; a name with ! is one to skip."""
    rows = features(spark, d).select(F.col("task").alias("label"), "feature").distinct()
    return rows.select("label", F.when(F.col("feature") == "l_tax", F.concat(F.lit("!"), "feature")).otherwise(F.col("feature")).alias("feature"))


def trip_configs(spark, d):
    out = folder(spark, "configs")
    S.write_configs(labelled_features(spark, d), out)
    return spark.read.text(out).select("label", F.explode(F.from_json("value", "array<string>")).alias("feature"))


def read_back_configs(spark, d):
    """Configurations in folders named for their label, read by the reader, which skips names with !."""
    out = folder(spark, "configs")
    S.config_rows(labelled_features(spark, d)).select(F.concat("label", F.lit(".json")).alias("file"), "config").write.partitionBy("file").text(out)
    return S.read_configs(spark, out)


QUERIES["snk_configs"], QUERIES["src_configs"] = trip_configs, read_back_configs
ORACLE_SQL["snk_configs"] = f"WITH {FEATURE_ROWS} SELECT DISTINCT task AS label, CASE WHEN feature = 'l_tax' THEN '!' ELSE '' END || feature AS feature FROM feat"
ORACLE_SQL["src_configs"] = f"WITH {FEATURE_ROWS} SELECT DISTINCT task AS label, feature FROM feat WHERE feature <> 'l_tax'"

# -- models ---------------------------------------------------------------------------------------------------------------------------------
COLUMNS = list(FEATURES)
TRAIN, TEST = "pid % 5 <> 0", "pid % 5 = 0"


def variance_fit(spark, d):
    f = features(spark, d).filter(TRAIN)
    return rounded(f.groupBy("feature").agg(F.var_pop("value").alias("v")).filter("v > 0.01"), 2)


QUERIES["mdl_variance_fit"] = variance_fit
ORACLE_SQL["mdl_variance_fit"] = f"WITH {FEATURE_ROWS} SELECT feature, round(var_pop(value), 2) AS v FROM feat WHERE {TRAIN} GROUP BY feature HAVING var_pop(value) > 0.01"
QUERIES["mdl_scale_fit"] = lambda spark, d: rounded(L.scaled(wide(spark, d).filter(TRAIN), wide(spark, d).filter(TEST), COLUMNS).select("pid", "task", "l_tax", "l_discount"), 5)
ORACLE_SQL["mdl_scale_fit"] = f"WITH {FEATURE_ROWS}, m AS (SELECT avg(l_tax) AS a, stddev_pop(l_tax) AS s, avg(l_discount) AS b, stddev_pop(l_discount) AS u FROM wide WHERE {TRAIN}) SELECT pid, task, round((l_tax - a) / s, 5) AS l_tax, round((l_discount - b) / u, 5) AS l_discount FROM wide, m WHERE {TEST}"
QUERIES["mdl_pca"] = lambda spark, d: L.principal_components(wide(spark, d), COLUMNS, 0.9)[0]


def classified(spark, d, train=TRAIN, test=TEST):
    base = wide(spark, d)
    fit, held = base.filter(train), base.filter(test)
    a, b = (L.fourier_features(L.scaled(fit, x, COLUMNS), COLUMNS, 24, 0.25) for x in (fit, held))
    return L.classify(a, b, [f"rf{k}" for k in range(24)]).select("pid", "task", "y", "yhat")


QUERIES["mdl_classifier"] = classified


def searched(spark, d) -> tuple[N.Search, DataFrame]:
    """All folds and trials over the features of all strides, a table partitioned by stride, and the rows with their folds."""
    out = folder(spark, "strided")
    # Rounded, so that the order in which means were added up cannot turn a fit.
    N.with_folds(strided(spark, d).na.drop()).write.partitionBy("stride").parquet(out)
    rows = spark.read.parquet(out)
    return N.Search(rows, COLUMNS, N.trials(12, strides=STRIDES)), rows


def wide_search(spark, d) -> W.WideSearch:
    """The same over a table of twenty rows and as many columns as there are components of vectors."""
    out = folder(spark, "spread")
    spread(spark, d).write.partitionBy("stride").parquet(out)
    return W.WideSearch(spark.read.parquet(out), N.trials(4), 3, 2)


QUERIES["mdl_group_folds"] = lambda spark, d: N.group_folds(wide(spark, d), 5)
ORACLE_SQL["mdl_group_folds"] = f"""WITH {FEATURE_ROWS}, pp AS (SELECT pid, count(*) FILTER (y = 0) AS n0, count(*) FILTER (y = 1) AS n1 FROM wide GROUP BY pid)
SELECT pid, ((row_number() OVER (PARTITION BY n0, n1 ORDER BY md5('42-' || pid)) - 1 + n0 + 2 * n1) % 5)::INT AS fold FROM pp"""
QUERIES["mdl_param_search"] = lambda spark, d: rounded(searched(spark, d)[0].trial_table(), 6)
QUERIES["mdl_nested_cv"] = lambda spark, d: rounded(searched(spark, d)[0].nested(), 6)
QUERIES["mdl_final_cv"] = lambda spark, d: rounded(searched(spark, d)[0].final(), 6)


def component_drops(spark, d):
    search, rows = searched(spark, d)
    return rounded(search.component_importance(rows), 6)


def feature_importance(spark, d):
    search, rows = searched(spark, d)
    return N.back_project(staged(search.component_importance(rows), "importance"), search.loadings())


QUERIES["imp_permutation"] = component_drops
QUERIES["imp_back_project"] = lambda spark, d: rounded(feature_importance(spark, d), 6)
QUERIES["imp_fold_summary"] = lambda spark, d: rounded(N.fold_summary(feature_importance(spark, d), features(spark, d)), 6)


def chosen_parameters(spark, d):
    """parameter, chosen, n: how often the folds chose a value."""
    picked = searched(spark, d)[0].trial_table().filter("chosen")
    pairs = F.create_map(*(x for c in ("stride", "penalty", "gamma", "share") for x in (F.lit(c), F.round(c, 6).cast("string"))))
    return picked.select(F.explode(pairs).alias("parameter", "chosen")).groupBy("parameter", "chosen").agg(F.count("*").alias("n"))


QUERIES["met_param_counts"] = chosen_parameters
QUERIES["mdl_pca_wide"] = lambda spark, d: rounded(W.components(spread(spark, d), 0.9)[0].select("stride", "pid", "task", F.posexplode("components").alias("component", "score")), 6)
QUERIES["mdl_nested_wide"] = lambda spark, d: rounded(wide_search(spark, d).nested(), 6)


def wide_importance(spark, d):
    search = wide_search(spark, d)
    return rounded(N.back_project(staged(search.component_importance(), "importance"), search.loadings()), 6)


QUERIES["imp_back_project_wide"] = wide_importance
