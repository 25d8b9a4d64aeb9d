"""Readers and writers of recordings, logs, configurations and results; keys come from paths, not order."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LOG_SCHEMA = "Timestamp double, step int, subStep string"
#: Files that a task writes, about: a file costs the same however short it is, so tasks are made by files, not by bytes.
FILES = 200
#: Bytes up to which a CSV file is read as one row and cut into lines; longer ones are read line by line, in splits.
SHORT = 1 << 20


def read_csv(spark: SparkSession, folder: str, schema: str, **named: Callable[[Column], Column]) -> DataFrame:
    """Rows of the CSV files with header at any depth, and columns ``named`` by each file's path, an encoded URI. To open a file for its lines costs about
    four times what it takes to read a short one whole, so only long ones are opened so; one listing serves both."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    size, names = F.col("_metadata.file_size"), [f(F.col("_metadata.file_path")).alias(n) for n, f in named.items()]
    lines = F.filter(F.split(F.col("content").cast("string"), "\r\n|\r|\n"), lambda line: F.trim(line) != "")
    # Names are worked out once a file.
    rows = files.filter(size <= SHORT).select(lines.alias("_lines"), *names).select(F.explode(F.slice("_lines", 2, F.size("_lines"))).alias("_line"), *named)
    short = rows.select(F.from_csv("_line", schema).alias("_row"), *named).select("_row.*", *named)
    # Files are told apart by the listing, so this opens none. The names are no patterns.
    long = [re.sub(r"([\\*?{}\[\]])", r"\\\1", r.path) for r in files.filter(size > SHORT).select("path").collect()]
    if not long:
        return short
    return short.unionByName(spark.read.schema(schema).option("header", True).csv(long).select("*", *names))


def read_tracking(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """CSV files of recordings in folders pid=..., at any depth; the id comes from the path, each file's own: the driver looks for no
    columns in the names of all folders."""
    plain = lambda c: F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))

    def pid(path: Column) -> Column:
        # The path is a URI, and in it the name is escaped as Spark's writers do.
        own = plain(plain(F.regexp_extract(path, r".*/pid=([^/]+)/", 1)))
        return F.when(own != "__HIVE_DEFAULT_PARTITION__", own)

    return read_csv(spark, folder, schema, pid=pid)


def read_named(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """CSV files named TASK_PERSON.csv, or in folders so named; task_id and pid come from the path."""
    found = lambda k: lambda path: F.regexp_extract(path, r"(?:^|[/=])([^/=_]+)_([^/=_]+)\.csv(?:/|$)", k)
    return read_csv(spark, folder, schema, task_id=found(1), pid=found(2))


def read_log(spark: SparkSession, folder: str) -> DataFrame:
    return read_tracking(spark, folder, LOG_SCHEMA)


def read_batches(spark: SparkSession, folders: list[str]) -> DataFrame:
    """The union of result batches; a column that one lacks is null there."""
    frames = [spark.read.parquet(f) for f in folders]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def read_configs(spark: SparkSession, folder: str) -> DataFrame:
    """label, feature: JSON arrays in files LABEL.json, or in folders so named; names with ! are skipped."""
    text = spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(folder)
    label = F.regexp_extract(F.col("_metadata.file_path"), r"(?:^|[/=])([^/=]+)\.json(?:/|$)", 1)
    return text.select(label.alias("label"), F.explode(F.from_json("value", "array<string>")).alias("feature")).filter(~F.col("feature").contains("!"))


def write_files(df: DataFrame, folder: str, keys: list[str], order: str, name: Callable[[list[str | None]], str]) -> None:
    """A CSV file with header for each key, called ``name`` of the key as text, its rows in ``order``; other columns are written, but
    for those with an underscore before them. A task holds about FILES keys and streams their lines, which Spark has formed, into one
    file after the other. Its folder part=... comes to its place when the task has ended, so one that ran twice leaves nothing that
    readers see. The folder is one that all executors reach and pyarrow opens and moves in (file:, hdfs:)."""
    uri = folder if "://" in folder or folder.startswith("/") else folder.replace("file:", "file://", 1)
    (files, top), held = fs.FileSystem.from_uri(uri), f"_held-{uuid.uuid4().hex}"
    columns = [c for c in df.columns if c not in keys and not c.startswith("_")]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, root = fs.FileSystem.from_uri(uri)
        own = f"{held}/{uuid.uuid4().hex}"
        lines = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True))
        some = False
        for key, rows in groupby(lines, lambda row: row[:-1]):
            path = f"{root}/{own}/{name(list(key))}"
            out.create_dir(path.rpartition("/")[0])
            with out.open_output_stream(path, buffer_size=1 << 16) as file:
                file.write((",".join(columns) + "\n").encode())
                for row in rows:
                    file.write(f"{row[-1]}\n".encode())
            some = True
        if some:
            yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int32()), "own": [own]})

    n = df.agg(F.approx_count_distinct(F.xxhash64(*keys))).first()[0]
    rows = df.repartition(max(1, -(-n // FILES)), *keys).sortWithinPartitions(*keys, order)
    texts = rows.select(*(F.col(k).cast("string").alias(k) for k in keys), F.to_csv(F.struct(*columns)).alias("_line"))
    if files.get_file_info(top).type != fs.FileType.NotFound:
        files.delete_dir_contents(top)
    files.create_dir(f"{top}/{held}")
    for part, own in texts.mapInArrow(write, "part int, own string").collect():  # a row for each task
        files.move(f"{top}/{own}", f"{top}/part={part}")
    files.delete_dir(f"{top}/{held}")


def write_by_key(df: DataFrame, folder: str, keys: list[str], order: str) -> None:
    """A CSV file for each key, in folders part=.../key=... named as Spark's writer names them, its rows in ``order``."""

    def name(values: list[str | None]) -> str:
        escaped = (re.sub(r"[\x01-\x1f\"#%'*/:=?\\\x7f{\[\]^]", lambda m: f"%{ord(m[0]):02X}", v) if v else "__HIVE_DEFAULT_PARTITION__" for v in values)
        return "/".join(f"{k}={v}" for k, v in zip(keys, escaped, strict=True)) + "/rows.csv"

    write_files(df, folder, keys, order, name)


def write_ranking(scores: DataFrame, folder: str, by: str) -> None:
    """Best first, ties by feature; ranges are sorted in parallel, so part files are in order."""
    scores.orderBy(F.desc(by), "feature").write.mode("overwrite").option("header", True).csv(folder)


def config_rows(features: DataFrame) -> DataFrame:
    """label, config: a JSON array of the features of each label."""
    return features.groupBy("label").agg(F.to_json(F.array_sort(F.collect_set("feature"))).alias("config"))


def write_configs(features: DataFrame, folder: str) -> None:
    config_rows(features).write.mode("overwrite").partitionBy("label").text(folder)


def best_run(runs: DataFrame, key: str, by: str) -> DataFrame:
    """The best row of each key; earlier fold wins a tie."""
    own = Window.partitionBy(key).orderBy(F.desc(by), "fold")
    return runs.withColumn("_k", F.row_number().over(own)).filter("_k = 1").drop("_k")
