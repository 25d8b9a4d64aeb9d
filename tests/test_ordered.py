"""Statistics that are rounded at halves, against their SQL on larger tables: no cell may turn."""

import math

import duckdb
import pytest

from stridewell.plans import catalog


def against_sql(spark, name, sf):
    """Cells of a query that differ from its SQL by more than a millionth."""
    folder = f"/root/testdata/sf{sf}"
    con = duckdb.connect()
    for t in ("events", "labels", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    got = catalog.QUERIES[name](spark, folder)
    want = con.execute(catalog.ORACLE_SQL[name])
    names = [c[0] for c in want.description]
    floats = [c for c, t in got.dtypes if t == "double"]
    split = lambda r: (tuple(r[c] for c in names if c not in floats), [r[c] for c in floats])
    none = lambda x: None if x is None or math.isnan(x) else x
    a, b = (dict(map(split, rows)) for rows in (got.collect(), [dict(zip(names, r, strict=True)) for r in want.fetchall()]))
    assert a.keys() == b.keys()
    near = lambda x, y: x == y if x is None or y is None else math.isclose(x, y, rel_tol=1e-6, abs_tol=1e-6)
    return [(k, x, b[k]) for k, x in a.items() if not all(near(none(u), none(v)) for u, v in zip(x, b[k], strict=True))]


@pytest.mark.parametrize(("name", "sf"), [("agg_cross_step", "0.01"), ("agg_by_type", "0.01"), ("agg_peak_gaps", "0.1"), ("agg_custom", "0.1"), ("res_cochran_q", "0.1")])
def test_no_cell_turns(spark, name, sf):
    assert not against_sql(spark, name, sf)
