"""Means that decide by their last bits: added up in the order of the rows, as the SQL does on one thread, however files are cut."""

import duckdb
import pyarrow.parquet as pq
import pytest

from stridewell.plans import catalog

FILES = 7


@pytest.fixture(scope="module")
def dealt(spark, tmp_path_factory):
    """The line items in their order, dealt to files that are read by tasks of their own: a supplier has rows in each."""
    out = tmp_path_factory.mktemp("dealt")
    (out / "lineitem.parquet").mkdir()
    lines = pq.read_table("/root/testdata/sf0.1/lineitem.parquet")
    size = -(-len(lines) // FILES)
    for part in range(FILES):
        pq.write_table(lines.slice(part * size, size), out / "lineitem.parquet" / f"part-{part:03d}.parquet")
    most = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(most)
    spark.conf.set(most, "1m")
    yield str(out)
    spark.conf.set(most, before)


@pytest.mark.parametrize("name", ["scr_ks2", "cln_onset_label"])
def test_equals_sql_on_one_thread(spark, dealt, name):
    con = duckdb.connect(config={"threads": 1})
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{dealt}/lineitem.parquet/*.parquet'")
    want = con.execute(catalog.ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    got = [tuple(r[c] for c in columns) for r in catalog.QUERIES[name](spark, dealt).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want.fetchall()))
