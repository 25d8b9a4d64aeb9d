"""Vector operators: lattice and curve by their definitions, near duplicates and hard negatives against brute force and SQL."""

from itertools import product

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stridewell.llm import hard_negatives as hard
from stridewell.llm import lattice_dedup as lattice
from stridewell.llm import queries

KIND = "vec_id long, embedding array<float>, label int"


def test_roots_and_nearest_points():
    assert len({tuple(r) for r in lattice.ROOTS}) == 240 and (np.abs((lattice.ROOTS**2).sum(1) - 2) < 1e-12).all()
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 8)) * 2
    near = lattice.nearest_point(x)
    assert ((near * 2) % 1 == 0).all() and (near.sum(1) % 2 == 0).all() and ((near % 1 == 0).all(1) | (near % 1 == 0.5).all(1)).all()
    # No point one or two roots away is nearer.
    more = np.concatenate([lattice.ROOTS, (lattice.ROOTS[:, None] + lattice.ROOTS[None]).reshape(-1, 8)])
    own = ((x - near) ** 2).sum(1)
    assert all((((x[k] - near[k] - more) ** 2).sum(1) >= own[k] - 1e-9).all() for k in range(len(x)))


def test_pairs_at_the_threshold_share_a_cell():
    rng = np.random.default_rng(2)
    n = 4000
    a = rng.normal(size=(n, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    w = rng.normal(size=(n, 64))
    w -= (w * a).sum(1, keepdims=True) * a
    w /= np.linalg.norm(w, axis=1, keepdims=True)
    b = lattice.COSINE * a + np.sqrt(1 - lattice.COSINE**2) * w
    none = np.zeros(n, np.uint64)
    ka, kb = (lattice.cells(x, none).reshape(n, -1) for x in (a, b))
    assert (ka[:, :, None] == kb[:, None, :]).any((1, 2)).mean() > 0.995


def groups(seed: int = 3) -> list[tuple]:
    """A hot group of near copies over several cells, chains, exact copies, and vectors that take no part."""
    rng = np.random.default_rng(seed)
    rows = []
    centre = rng.normal(size=16)
    for k in range(400):
        rows.append((centre + rng.normal(size=16) * (0.08 if k % 3 else 0.35), 1 if k % 7 else 2))
    for _ in range(40):
        x = rng.normal(size=16)
        for _ in range(4):
            rows.append((x, int(rng.integers(0, 3))))
            x = x + rng.normal(size=16) * 0.3
    rows += [(rows[5][0], rows[5][1])] * 30
    made = [(k, [float(v) for v in x], label) for k, (x, label) in enumerate(rows)]
    odd = [(None, made[5][1], 1), (5, made[5][1], 1), (5, [1.0] * 16, 1), (9000, None, 1), (9001, [], 1), (9002, [0.0] * 16, 1), (9003, [float("nan")] * 16, 1), (9004, [None] * 16, 1), (9005, made[5][1], None), (9006, [float("inf")] + [1.0] * 15, 1), (9007, [1.0, 2.0], 1), (9008, [2.0, 4.0], 1), (9009, [3e38] * 16, 1), (9010, [1e-40] * 16, 1)]
    return made + odd


def frame(spark, rows):
    return spark.createDataFrame(rows, KIND).repartition(5).withColumns({"row": F.lit(1), "cells": F.lit("x"), "node": F.lit(2), "block": F.lit(0), "anchor": F.lit("y")})


def near_by_hand(rows) -> list[tuple]:
    unit = []
    for _, v, label in rows:
        x = np.array(v, np.float32).astype(float) if label is not None and v and None not in v else np.zeros(0)
        fit = len(x) and np.isfinite(x).all() and x.any()
        x = x / np.abs(x).max() if fit else x
        unit.append(x / np.linalg.norm(x) if fit else None)
    near = [[j for j, v in enumerate(unit) if j != i and u is not None and v is not None and len(u) == len(v) and rows[i][2] == rows[j][2] and u @ v >= lattice.COSINE] for i, u in enumerate(unit)]
    out = []
    for i in range(len(rows)):
        seen, open_ = {i}, [i]
        while open_:
            open_ += (new := [j for j in near[open_.pop()] if j not in seen])
            seen.update(new)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        out.append((rows[i][0], len(near[i]), min(ids) if ids else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("block, many, few", [(1024, 64, 48), (32, 16, 4), (16, 10_000, 2)])
def test_near_duplicates_equal_all_pairs(spark, monkeypatch, block, many, few):
    monkeypatch.setattr(lattice, "BLOCK", block)
    monkeypatch.setattr(lattice, "MANY", many)
    rows = groups()
    got = [tuple(r) for r in lattice.near_duplicates(frame(spark, rows)).collect()]
    assert sorted(got, key=str) == near_by_hand(rows)


def test_bundles_never_part_a_tile(spark, monkeypatch):
    monkeypatch.setattr(lattice, "BUNDLE", 7)
    rows = groups()[:420]
    assert sorted(map(tuple, lattice.near_duplicates(frame(spark, rows)).collect()), key=str) == near_by_hand(rows)


def test_curve_visits_neighbours():
    for axes, bits in ((2, 4), (3, 3), (4, 2)):
        points = np.array(list(product(range(1 << bits), repeat=axes)))
        place = hard.curve_places(points, bits)
        assert sorted(place) == list(range(len(points)))
        assert (np.abs(np.diff(points[np.argsort(place)], axis=0)).sum(1) == 1).all()


def test_bounds_hold_every_product():
    rng = np.random.default_rng(4)
    a, x = rng.integers(-300, 300, (40, 12)), rng.integers(-300, 300, (60, 12))
    down, up = hard.bounds(a, x.min(0)[None], x.max(0)[None])
    score = hard.products(a, x)
    assert (down[:, 0] <= score.min(1)).all() and (score.max(1) <= up[:, 0]).all()
    big = np.array([[1 << 61, -3], [5, 1 << 40]])
    assert hard.products(big, np.array([[1 << 3, 1], [0, 7]])).tolist() == [[hard.LARGEST, -21], [40 + (1 << 40), 7 << 40]]


def mined_by_hand(rows) -> list[tuple]:
    made = [(i, np.floor(256.0 * np.array(v, np.float32).astype(float)).astype(int).tolist(), label) for i, v, label in rows if label is not None and v and None not in v and np.isfinite(np.array(v, np.float32)).all()]
    made = [(i, v, (label + 1) % 10 if i is not None and i % 7 == 0 else label) for i, v, label in made]
    out = []
    for a, (i, v, label) in enumerate(made):
        if i is None or i % 50:
            continue
        scored = [(-sum(x * y for x, y in zip(v, u, strict=True)), (j is None, j), j, k == label) for b, (j, u, k) in enumerate(made) if b != a and len(u) == len(v)]
        scored.sort(key=lambda s: (s[0], s[1][0], s[1][1] or 0))
        for s, _, p, _ in [x for x in scored if x[3]][:5]:
            fit = [x for x in scored if not x[3] and 50 * -s <= 100 * -x[0] <= 95 * -s][:3]
            out += [(i, p, r, x[2], -s, -x[0]) for r, x in enumerate(fit, 1)]
    return sorted(out, key=str)


def mined(spark, rows):
    label = F.when(F.coalesce(F.col("vec_id") % 7 == 0, F.lit(False)), (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return sorted(map(tuple, hard.mine(hard.whole_points(frame(spark, rows), label, F.col("vec_id") % 50 == 0, 256.0)).collect()), key=str)


@pytest.mark.parametrize("block, page, group", [(256, 512, 64), (8, 4, 2)])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, block, page, group):
    monkeypatch.setattr(hard, "BLOCK", block)
    monkeypatch.setattr(hard, "PAGE", page)
    monkeypatch.setattr(hard, "GROUP", group)
    rows = [r for r in groups(5) if r[0] not in (9009,)] + [(9050, [1.0, 2.0], 3), (100, groups(5)[7][1], 2)]
    assert mined(spark, rows) == mined_by_hand(rows)


def test_zone_maps_spare_blocks(spark, monkeypatch):
    """Well apart clusters: the windows of an anchor reach few of the blocks of other labels."""
    monkeypatch.setattr(hard, "BLOCK", 16)
    rng = np.random.default_rng(6)
    rows = []
    for c in range(20):
        x = np.zeros(8)
        x[c % 8] = 1.0 if c < 8 else -1.0
        rows += [(1000 * c + 25 * k, [float(v) for v in x + rng.normal(size=8) * 0.02], c % 10) for k in range(40)]
    label = F.col("label")
    points = hard.whole_points(frame(spark, rows), label, F.col("vec_id") % 50 == 0, 256.0)
    made = hard.blocks(points)
    zones = made.filter("least IS NOT NULL").select("block", "label", "size", "least", "most")
    anchors = made.filter("anchor AND vec_id < 50").select("block", "pos", "vec_id", "label", "size", "point", "seed", F.lit(0).cast("long").alias("chunk"))
    asking = anchors.withColumn("scores", F.array(F.lit(65_000)))
    assert hard.plan(asking, zones, hard.windows_below, False).count() < 0.5 * zones.count()


def test_empty_tables(spark):
    none = frame(spark, groups()[:3]).limit(0)
    assert lattice.near_duplicates(none).count() == 0
    assert hard.mine(hard.whole_points(none, F.col("label"), F.col("vec_id") % 50 == 0, 256.0)).count() == 0
    odd = frame(spark, [(1, None, 1), (50, [1.0, 2.0], None)])
    assert sorted(map(tuple, lattice.near_duplicates(odd).collect())) == [(1, 0, 1), (50, 0, 50)]


@pytest.mark.parametrize("name", ["op12_lattice_dedup", "op13_hard_negatives"])
def test_queries_equal_sql(spark, tmp_path, name):
    frame(spark, [r for r in groups() if r[0] not in (9009, 9010, 5, None)]).select("vec_id", "embedding", "label").write.parquet(f"{tmp_path}/embeddings.parquet")
    for folder in (str(tmp_path), "/root/testdata/sf0.001"):
        with duckdb.connect() as duck:
            duck.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{folder}/embeddings.parquet{'' if 'testdata' in folder else '/*.parquet'}')")
            want = duck.execute(queries.ORACLE_SQL[name]).df()
        got = queries.QUERIES[name](spark, folder).toPandas()
        order = lambda d: d[sorted(d.columns)].sort_values(sorted(d.columns)).reset_index(drop=True)
        assert len(want) > 100
        pd.testing.assert_frame_equal(order(got), order(want), check_dtype=False)
