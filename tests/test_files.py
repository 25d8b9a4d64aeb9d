"""A file for each key, written by tasks that are as many as the files ask for."""

import os

from pyspark.sql import functions as F

from stridewell.sources import files as S


def written(folder):
    return sorted(os.path.relpath(os.path.join(d, f), folder) for d, _, names in os.walk(folder) for f in names if not f.startswith((".", "_")))


def test_files_are_dealt_by_their_number(spark, tmp_path):
    """Rows of few bytes went to one task, which wrote all files; folders of all keys were moved and listed one by one."""
    persons = 5 * S.FILES
    rows = spark.range(3 * persons).select((F.col("id") % persons).alias("pid"), F.floor(F.col("id") / persons).alias("idx"), (F.col("id") / 7).alias("x"))
    out = str(tmp_path / "log")
    S.write_by_key(rows.withColumn("idx", 2 - F.col("idx")), out, ["pid"], "idx")
    found = written(out)
    assert len(found) == persons and len({os.path.dirname(f) for f in found}) == persons
    tasks = [n.split(os.sep)[0] for n in found]
    assert len(set(tasks)) >= 4 and max(map(tasks.count, tasks)) < 2 * S.FILES
    assert open(os.path.join(out, found[0])).read().splitlines()[0] == "idx,x"
    assert [line.split(",")[0] for line in open(os.path.join(out, found[0])).read().splitlines()[1:]] == ["0", "1", "2"]
    back = S.read_tracking(spark, out, "idx long, x double").select(F.col("pid").cast("long").alias("pid"), (2 - F.col("idx")).alias("idx"), "x")
    assert back.count() == 3 * persons and not back.exceptAll(rows).count()


def test_odd_keys_and_cells_come_back(spark, tmp_path):
    rows = [("a/b", 0, 'x,"y"'), ("a b+c%20", 1, None), (None, 2, "z"), ("é=1", 3, "")]
    table = spark.createDataFrame(rows, "pid string, idx int, text string")
    ours, native = str(tmp_path / "ours"), str(tmp_path / "native")
    S.write_by_key(table, ours, ["pid"], "idx")
    table.write.partitionBy("pid").option("header", True).csv(native)
    texts = lambda folder: sorted((os.path.dirname(f).split(os.sep)[-1], open(os.path.join(folder, f)).read()) for f in written(folder))
    assert texts(ours) == texts(native)
    cells = lambda folder: sorted(map(str, S.read_tracking(spark, folder, "idx int, text string").select("pid", "idx", "text").collect()))
    assert cells(ours) == cells(native) and [r.split("'")[1] for r in cells(ours)[:2]] == ["a b+c%20", "a/b"]
    S.write_by_key(table.limit(0), ours, ["pid"], "idx")
    assert not written(ours) and S.read_log(spark, ours).count() == 0


def test_short_files_are_read_whole_and_long_ones_by_line(spark, tmp_path, monkeypatch):
    """Every short file was opened for its lines, which took most of the time; both ways give what Spark's reader gives."""
    schema = "idx int, x double, text string"
    cells = ["idx,x,text\n0,1.5,a\n1,,b\n", "idx,x,text\r\n0,2.5,\"a,b\"\r\n\r\n1,3.5,\"\"", "\ufeffidx,x,text\n  \n7,0.1, é \n", "idx,x,text\n", "", "\n\nidx,x,text\r3,bad,z\r4,1\r", "idx,x,text\n" + "".join(f"{k},{k / 3},{k}\n" for k in range(50))]
    for k, text in enumerate(cells):
        (tmp_path / f"part=0/pid={k} [a]").mkdir(parents=True)
        (tmp_path / f"part=0/pid={k} [a]" / "rows.csv").write_bytes(text.encode())
    native = spark.read.schema(schema).option("header", True).option("recursiveFileLookup", True).csv(str(tmp_path))
    wanted = sorted(str((r.idx, r.x, r.text, r.p.split("pid=")[1][0])) for r in native.select("*", F.col("_metadata.file_path").alias("p")).collect())
    assert len(wanted) == 57
    for bound in (S.SHORT, 40, -1):
        monkeypatch.setattr(S, "SHORT", bound)
        back = S.read_tracking(spark, str(tmp_path), schema)
        assert back.columns == ["idx", "x", "text", "pid"] and sorted(str((r.idx, r.x, r.text, r.pid[0])) for r in back.collect()) == wanted
        plan = back._jdf.queryExecution().toString().lower().replace("from_csv", "").replace(".csv", "")
        assert ("csv" in plan) == (bound <= 40)
