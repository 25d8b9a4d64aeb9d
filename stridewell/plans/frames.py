"""Driver tables in the roles of recordings, logs, feature tables and predictions, with the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Numeric columns of lineitem that act as features.
FEATURES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def recording(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pid, idx, t (seconds; a session starts at 1000 and a few more, by user), x, kind: events as one recording a user."""
    own = Window.partitionBy("user_id")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("pid"),
        (F.row_number().over(own.orderBy("ts", "event_id")) - 1).cast("long").alias("idx"),
        ((us - F.min(us).over(own)) / 1e6 + 1000.0 + F.col("user_id") % 13).alias("t"),
        F.col("value").alias("x"),
        F.col("event_type").alias("kind"),
    )


RECORDING = """rec AS (SELECT user_id AS pid, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx,
  (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 1e6 + 1000.0 + user_id % 13 AS t, value AS x, event_type AS kind FROM events)"""


def path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pid, idx, t, position px py pz and unit quaternion qx qy qz qw: embeddings of a label in order of id."""
    e = lambda k: F.col("embedding")[k].cast("double")
    norm = F.sqrt(sum((e(k) * e(k) for k in range(4, 7)), e(3) * e(3)))
    return table(spark, sf_dir, "embeddings").select(
        F.col("label").cast("long").alias("pid"),
        (F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1).cast("long").alias("idx"),
        *(e(k).alias(n) for k, n in enumerate(("px", "py", "pz"))),
        *((e(k + 3) / norm).alias(n) for k, n in enumerate(("qx", "qy", "qz", "qw"))),
    ).withColumn("t", F.col("idx") / 10.0)


PATH = """raw AS (SELECT label::BIGINT AS pid, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS idx, embedding AS e,
  sqrt(e[4]::DOUBLE * e[4] + e[5]::DOUBLE * e[5] + e[6]::DOUBLE * e[6] + e[7]::DOUBLE * e[7]) AS n FROM embeddings),
pt AS (SELECT pid, idx, idx / 10.0::DOUBLE AS t, e[1]::DOUBLE AS px, e[2]::DOUBLE AS py, e[3]::DOUBLE AS pz,
  e[4]::DOUBLE / n AS qx, e[5]::DOUBLE / n AS qy, e[6]::DOUBLE / n AS qz, e[7]::DOUBLE / n AS qw FROM raw)"""


#: Objects of a recording and the first of the three dimensions that act as their position.
OBJECTS = {"Head": 0, "LeftHand": 7, "RightHand": 10}


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pid, idx, object, px, py, pz: ``path`` with three objects a sample."""
    own = Window.partitionBy("label").orderBy("vec_id")
    spots = F.array(*(F.struct(F.lit(o).alias("object"), *(F.col("embedding")[k + i].cast("double").alias(f"p{c}") for i, c in enumerate("xyz"))) for o, k in OBJECTS.items()))
    rows = table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("pid"), (F.row_number().over(own) - 1).cast("long").alias("idx"), spots.alias("o"))
    return rows.select("pid", "idx", F.explode("o").alias("o")).select("pid", "idx", "o.*")


OBJECT_ROWS = "raw AS (SELECT label::BIGINT AS pid, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS idx, embedding AS e FROM embeddings), ob AS (" + " UNION ALL ".join(
    f"SELECT pid, idx, '{o}' AS object, e[{k + 1}]::DOUBLE AS px, e[{k + 2}]::DOUBLE AS py, e[{k + 3}]::DOUBLE AS pz FROM raw" for o, k in OBJECTS.items()
) + ")"


def in_row_order(lines: DataFrame, keys: list[str]) -> DataFrame:
    """``lines`` (with the table's hidden ``_metadata``) dealt by ``keys``, each group's rows beside each other and as they stand in the
    files. Grouped by the same keys they are added up one after the other, as the SQL does on one thread: equal groups get equal
    last bits, however a file is cut into tasks."""
    at = lines.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    return at.repartition(*keys).sortWithinPartitions(*keys, "_file", "_row")


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pid, task, feature, value, y in long form: means of line items by supplier and line status; the label is
    whether the mean of their order keys modulo seven is over three."""
    lines = in_row_order(table(spark, sf_dir, "lineitem"), ["l_suppkey", "l_linestatus"])
    means = lines.groupBy(F.col("l_suppkey").alias("pid"), F.col("l_linestatus").alias("task")).agg(
        *(F.avg(c).alias(c) for c in FEATURES), (F.avg(F.col("l_orderkey") % 7) > 3).cast("int").alias("y")
    )
    return means.unpivot(["pid", "task", "y"], list(FEATURES), "feature", "value").select("pid", "task", "feature", "value", "y")


#: Strides of the feature table, and how many lines of an order go together in the role of each.
STRIDES = (1, 9, 45, 90, 225, 450)


def strided(spark: SparkSession, sf_dir: str) -> DataFrame:
    """stride, pid, task, y and a column for each feature: ``features`` of the lines whose number the stride's place divides."""
    lines = table(spark, sf_dir, "lineitem")
    every = lines.withColumn("_k", F.explode(F.array(*(F.struct(F.lit(s).alias("stride"), F.lit(k).alias("k")) for k, s in enumerate(STRIDES, 1))))).filter(F.col("l_linenumber") % F.col("_k.k") == 0)
    means = every.groupBy(F.col("_k.stride").alias("stride"), F.col("l_suppkey").alias("pid"), F.col("l_linestatus").alias("task")).agg(*(F.round(F.avg(c), 6).alias(c) for c in FEATURES))
    label = lines.groupBy(F.col("l_suppkey").alias("pid"), F.col("l_linestatus").alias("task")).agg((F.avg(F.col("l_orderkey") % 7) > 3).cast("int").alias("y"))
    return means.join(label, ["pid", "task"])


def spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """stride, pid, task, y, feature, value: a table of few rows and many columns; a label's vectors, dealt to two tasks, are its
    columns, each component of each vector one of its own."""
    own = Window.partitionBy("label", F.col("vec_id") % 2).orderBy("vec_id")
    rows = table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("pid"), F.when(F.col("vec_id") % 2 == 0, "A").otherwise("B").alias("task"), F.row_number().over(own).alias("_n"), F.posexplode("embedding").alias("_i", "_v"))
    feature, y = F.concat(F.lit("v"), F.col("_n").cast("string"), F.lit("_"), F.col("_i").cast("string")), (F.col("pid") % 2).cast("int")
    return rows.select(F.lit(1).alias("stride"), "pid", "task", y.alias("y"), feature.alias("feature"), (F.col("_v").cast("double") * 8).alias("value"))


FEATURE_ROWS = """wide AS (SELECT l_suppkey AS pid, l_linestatus AS task, avg(l_quantity) AS l_quantity, avg(l_extendedprice) AS l_extendedprice,
  avg(l_discount) AS l_discount, avg(l_tax) AS l_tax, (avg(l_orderkey % 7) > 3)::INT AS y FROM lineitem GROUP BY ALL),
feat AS (SELECT pid, task, feature, value, y FROM (UNPIVOT wide ON l_quantity, l_extendedprice, l_discount, l_tax INTO NAME feature VALUE value))"""


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """label, fold, pid, task, y, yhat: labels as predictions of a classifier, five folds, two tasks."""
    return table(spark, sf_dir, "labels").select(
        F.when(F.col("doc_id") % 7 < 3, "Head_linear").otherwise("LeftHand_angular").alias("label"),
        (F.floor(F.col("doc_id") / 2) % 5).cast("int").alias("fold"),
        (F.floor(F.col("doc_id") / 2) % 25).alias("pid"),
        F.when(F.col("doc_id") % 2 == 0, "A").otherwise("B").alias("task"),
        F.col("quality").cast("int").alias("y"),
        (1 - F.col("toxic")).cast("int").alias("yhat"),
    )


PREDICTIONS = """pred AS (SELECT CASE WHEN doc_id % 7 < 3 THEN 'Head_linear' ELSE 'LeftHand_angular' END AS label, ((doc_id // 2) % 5)::INT AS fold,
  (doc_id // 2) % 25 AS pid, CASE WHEN doc_id % 2 = 0 THEN 'A' ELSE 'B' END AS task, quality::INT AS y, (1 - toxic)::INT AS yhat FROM labels)"""


def design(spark: SparkSession, sf_dir: str) -> DataFrame:
    """subject, a, b, value: mean order price by nation, priority and status, a within-subject design."""
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    joined = orders.join(customers, orders["o_custkey"] == customers["c_custkey"])
    return joined.groupBy(F.col("c_nationkey").alias("subject"), F.col("o_orderpriority").alias("a"), F.col("o_orderstatus").alias("b")).agg(F.avg("o_totalprice").alias("value"))


DESIGN = """dsg AS (SELECT c_nationkey AS subject, o_orderpriority AS a, o_orderstatus AS b, avg(o_totalprice) AS value
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)"""
