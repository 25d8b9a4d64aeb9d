"""Near-duplicate vectors by lattice hashing.

1. Equal vectors of a label are one node. Each node's direction is projected at random, ``PARTS`` times eight numbers a
   table, and each eight are decoded to the nearest point of the lattice E8. A table's cell is the tuple of its points; with
   it a node enters the neighbouring cells whose centres lie nearest to its projection (``PROBES``, by the roots of E8).
   Two directions at the threshold share a cell in one of the ``TABLES`` with a chance of 0.9995, closer ones more.
2. Full cells get a centre, the mean direction of their members. Members within half the threshold's angle of a centre
   form a ball: all of them are linked with each other (angles add up), which needs no look at pairs. So a group of very many
   near copies costs its number, not its square.
3. The members of a cell meet in tiles of two blocks of at most about ``BLOCK`` rows; two of one ball do not meet. Cosines are
   computed in double precision on the whole vectors. A pair that shares several cells counts in one of them (the
   least of the first table where they meet); a tile returns a number of links and a link to the least of its component for
   each row, never pairs.
4. Components of those links.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and those without label, link
with nothing; nor do vectors of different length. Rows that share a vec_id are rows of their own; a null vec_id names
no component unless nothing else is there. An empty table has no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations, product
from math import acos, cos

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fields, release_memory, small, staged, workers_import_this
from .minhash_dedup import connected

COSINE = 0.93
TABLES, PARTS, PROBES, SCALE = 4, 2, 8, 0.5
#: Rows of a block of a cell.
BLOCK = 1024
#: Members from which on a cell gets a centre, and the least length of the mean of its directions.
MANY, AGREE = 64, 0.5
#: Rows of small tiles that are compared at once, and the size up to which a tile is small.
BUNDLE, FEW = 4096, 48
#: Sums of cells that a task holds before it hands them on.
HELD = 4096
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _roots() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    whole = [[a if k == i else b if k == j else 0.0 for k in range(8)] for i, j in combinations(range(8), 2) for a in (1.0, -1.0) for b in (1.0, -1.0)]
    halves = [s for s in product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array([*whole, *halves])


ROOTS = _roots()


def _nearest_even(x: np.ndarray) -> np.ndarray:
    """The nearest whole points with even sum: round, and where the sum is odd round the worst place the other way."""
    near = np.rint(x)
    off = x - near
    rows = np.flatnonzero(near.sum(1) % 2)
    worst = np.abs(off[rows]).argmax(1)
    near[rows, worst] += np.where(off[rows, worst] >= 0, 1.0, -1.0)
    return near


def nearest_point(x: np.ndarray) -> np.ndarray:
    """The nearest point of E8 of each row: the better one of its two shifted halves."""
    a, b = _nearest_even(x), _nearest_even(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1))[:, None], a, b)


@lru_cache(8)
def _projection(dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng(7)
    n = 8 * PARTS * TABLES
    return rng.normal(size=(dim, n)) * SCALE, rng.random(n) * 2, rng.integers(1, 1 << 63, size=(TABLES, PARTS, 8), dtype=np.uint64) | np.uint64(1)


def cells(unit: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Of each direction, by table: its own cell and the next nearest ones, as numbers; ``labels`` are mixed in."""
    matrix, shift, mix = _projection(unit.shape[1])
    at, out = unit @ matrix + shift, []
    with np.errstate(over="ignore"):
        for table in range(TABLES):
            key, far = labels[:, None] * _MIX, np.zeros((len(unit), 1))
            for part in range(PARTS):
                lo = 8 * (table * PARTS + part)
                x = at[:, lo : lo + 8]
                own = nearest_point(x)
                more = 2 - 2 * (x - own) @ ROOTS.T  # how much farther the neighbouring points are
                best = np.argpartition(more, PROBES, axis=1)[:, :PROBES]
                points = np.concatenate([own[:, None], own[:, None] + ROOTS[best]], 1)
                hashed = ((points * 2).astype(np.int64).view(np.uint64) * mix[table, part]).sum(-1, dtype=np.uint64)
                added = np.concatenate([np.zeros((len(x), 1)), np.take_along_axis(more, best, 1)], 1)
                key = ((key[:, :, None] ^ hashed[:, None, :]) * _MIX).reshape(len(x), -1)
                key ^= key >> np.uint64(31)
                far = (far[:, :, None] + added[:, None, :]).reshape(len(x), -1)
                keep = np.argpartition(far, PROBES, axis=1)[:, : PROBES + 1]
                keep = np.take_along_axis(keep, np.argsort(np.take_along_axis(far, keep, 1), axis=1, kind="stable"), 1)
                key, far = np.take_along_axis(key, keep, 1), np.take_along_axis(far, keep, 1)
            out.append(key)
    return np.stack(out, 1).view(np.int64)


def label_numbers(labels: list[str]) -> np.ndarray:
    known = {x: xxhash.xxh3_64_intdigest(x) for x in set(labels)}
    return np.fromiter((known[x] for x in labels), np.uint64, len(labels))


def directions(column: pa.Array, kind: str) -> list[tuple[np.ndarray, np.ndarray]]:
    """Vectors (bytes) as (rows, unit vectors in double precision), for each length by itself."""
    raw = column.to_pylist()
    lengths, found = np.array([len(v) for v in raw]), []
    for n in np.unique(lengths):
        rows = np.flatnonzero(lengths == n)
        x = np.frombuffer(b"".join(raw[r] for r in rows), kind).reshape(len(rows), -1).astype(np.float64)
        x = x / np.abs(x).max(1, keepdims=True)
        found.append((rows, x / np.sqrt((x * x).sum(1, keepdims=True))))
    return found


def vector_rows(embeddings: DataFrame) -> tuple[DataFrame, str]:
    """row, vec_id, label, digest (equal for equal vectors of a label) and vector (bytes; both null where a row takes
    no part), and the kind of number in the bytes."""
    held = embeddings.schema["embedding"].dataType
    kind, name = ("<f4", "float") if isinstance(held, T.ArrayType) and isinstance(held.elementType, T.FloatType) else ("<f8", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, vectors = [], []
            for label, v in zip(batch.column("label").to_pylist(), batch.column("embedding").to_pylist(), strict=True):
                x = np.array(v, kind) if label is not None and v and None not in v else np.zeros(0, kind)
                fit = np.isfinite(x).all() and x.any()
                vectors.append((x + 0).tobytes() if fit else None)
                digests.append(xxhash.xxh3_128_digest(f"{label}\n".encode() + vectors[-1]) if fit else None)
            arrays = [batch.column("row"), batch.column("vec_id"), batch.column("label"), pa.array(digests, pa.binary()), pa.array(vectors, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["row", "vec_id", "label", "digest", "vector"])

    workers_import_this(embeddings.sparkSession)
    source = embeddings.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast(f"array<{name}>").alias("embedding"))
    return source.mapInArrow(run, fields(("row", "long"), ("vec_id", "long"), ("label", "string"), ("digest", "binary"), ("vector", "binary"))), kind


def with_cells(df: DataFrame, kind: str) -> DataFrame:
    """``df`` with the cells of its ``vector`` and ``label``. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(at, BLOCK)
                labels = label_numbers(batch.column("label").to_pylist())
                found = np.zeros((batch.num_rows, TABLES * (PROBES + 1)), np.int64)
                for rows, unit in directions(batch.column("vector"), kind):
                    found[rows] = cells(unit, labels[rows]).reshape(len(rows), -1)
                flat = pa.ListArray.from_arrays(np.arange(0, found.size + 1, found.shape[1], dtype=np.int32), pa.array(found.ravel()))
                yield pa.RecordBatch.from_arrays([*batch.columns, flat], names=[*batch.schema.names, "cells"])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("cells", T.ArrayType(T.LongType()))]))


def centres(nodes: DataFrame, kind: str) -> DataFrame:
    """centre, size, vector (double) and cells of the mean direction of each full cell of the first table. Directions are
    summed in each task first, so a cell that most rows share moves as few sums."""
    own = nodes.select("label", "vector", F.col("cells")[0].alias("cell"))
    full = own.groupBy("cell").agg(F.count("*").alias("c")).filter(F.col("c") >= MANY).select("cell")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, list] = {}

        def handed() -> pa.RecordBatch:
            columns = [[k[0] for k in sums], [k[1] for k in sums], [k[2] for k in sums], [v[0] for v in sums.values()], [v[1].tolist() for v in sums.values()]]
            kinds = (pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.list_(pa.float64()))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["cell", "label", "dim", "n", "total"])

        for batch in batches:
            cell, label = batch.column("cell").to_numpy(), np.array(batch.column("label").to_pylist(), object)
            for rows, unit in directions(batch.column("vector"), kind):
                order = rows[np.argsort(cell[rows], kind="stable")]
                place = np.empty(len(cell), np.int64)
                place[rows] = np.arange(len(rows))
                starts = np.concatenate([[0], np.flatnonzero(np.diff(cell[order])) + 1])
                total = np.add.reduceat(unit[place[order]], starts)
                for first, s, n in zip(order[starts], total, np.diff(np.append(starts, len(order))), strict=True):
                    held = sums.setdefault((int(cell[first]), label[first], unit.shape[1]), [0, np.zeros(unit.shape[1])])
                    held[0] += int(n)
                    held[1] += s
            if len(sums) > HELD:
                yield handed()
                sums.clear()
        if sums:
            yield handed()

    members = own.join(small(staged(full, "lattice-full")), "cell", "left_semi").select("cell", "label", "vector")
    parts = staged(members.mapInArrow(run, fields(("cell", "long"), ("label", "string"), ("dim", "int"), ("n", "long"), ("total", "array<double>"))), "lattice-sums")
    keys = ["cell", "label", "dim"]
    by_place = parts.select(*keys, F.posexplode("total").alias("pos", "x")).groupBy(*keys, "pos").agg(F.sum("x").alias("x"))
    vector = by_place.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("total"))
    sized = parts.groupBy(*keys).agg(F.sum("n").alias("size"))
    length = F.sqrt(F.aggregate("total", F.lit(0.0), lambda a, x: a + x * x))
    agreed = vector.join(sized, keys).filter(length >= AGREE * F.col("size"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = pa.array([np.array(v).tobytes() for v in batch.column("total").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("label"), batch.column("size"), vectors], names=["label", "size", "vector"])

    found = agreed.select("label", "size", "total").mapInArrow(packed, fields(("label", "string"), ("size", "long"), ("vector", "binary")))
    return staged(with_cells(found.withColumn("centre", F.monotonically_increasing_id()), "<f8"), "lattice-centres")


def balls(nodes: DataFrame, kind: str, cosine: float) -> DataFrame:
    """node, ball: of the centres within half the threshold's angle the one of the fullest cell."""
    least = cos(acos(cosine) / 2) + 1e-9
    centre = centres(nodes, kind)
    at = centre.select("centre", F.explode("cells").alias("cell"))
    met = nodes.select("node", F.explode("cells").alias("cell")).join(small(at), "cell").select("node", "centre").distinct()
    there = small(centre.select("centre", "size", F.col("vector").alias("middle"), F.col("label").alias("of")))
    both = met.join(nodes.select("node", "label", "vector"), "node").join(there, "centre").filter(F.col("label") == F.col("of")).select("node", "centre", "size", "vector", "middle")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(start, BLOCK)
                inside = np.zeros(batch.num_rows, bool)
                mids = batch.column("middle").to_pylist()
                for rows, unit in directions(batch.column("vector"), kind):
                    own = [k for k, r in enumerate(rows) if len(mids[r]) == 8 * unit.shape[1]]
                    if own:
                        middle = directions(pa.array([mids[rows[k]] for k in own], pa.binary()), "<f8")[0][1]
                        inside[rows[own]] = (unit[own] * middle).sum(1) >= least
                yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(inside)) for c in ("node", "centre", "size")], names=["node", "centre", "size"])

    near = both.mapInArrow(run, fields(("node", "long"), ("centre", "long"), ("size", "long")))
    return near.groupBy("node").agg(F.max(F.struct("size", "centre")).alias("m")).select("node", F.col("m.centre").alias("ball"))


def tiles(nodes: DataFrame, ball: DataFrame) -> DataFrame:
    """cell, lo, hi (a tile), block, node, label, vector, copies. A cell's loose members, and those of each ball in it, fill blocks
    of their own; a block meets every block of its cell but those of its own ball."""
    placed = nodes.select("node", "cells").join(ball, "node", "left").select("node", F.coalesce("ball", F.lit(-1)).alias("ball"), F.explode("cells").alias("cell"))
    placed = staged(placed, "lattice-places")
    groups = placed.groupBy("cell", "ball").agg(F.count("*").alias("c"))
    own = Window.partitionBy("cell")
    blocks = F.ceil(F.col("c") / BLOCK).cast("int")
    layout = groups.select(
        "cell",
        "ball",
        blocks.alias("blocks"),
        (F.sum(blocks).over(own.orderBy("ball").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - blocks).cast("int").alias("first"),
        F.sum(blocks).over(own).cast("int").alias("total"),
        (F.sum("c").over(own) > F.when(F.col("ball") < 0, 1).otherwise(F.col("c"))).alias("met"),
    ).filter("met")
    entries = placed.join(layout, ["cell", "ball"]).select("node", "cell", "ball", "blocks", "first", "total", (F.col("first") + F.pmod(F.xxhash64("node"), F.col("blocks"))).cast("int").alias("block"))
    meets = F.filter(F.sequence(F.lit(0), F.col("total") - 1), lambda j: (F.col("ball") < 0) | (j < F.col("first")) | (j >= F.col("first") + F.col("blocks")))
    full = entries.select("node", "cell", "block", meets.alias("meets")).join(nodes.select("node", "label", "vector", "copies"), "node")
    dealt = full.select("cell", "block", "node", "label", "vector", "copies", F.explode("meets").alias("j"))
    return dealt.select("cell", F.least("block", "j").alias("lo"), F.greatest("block", "j").alias("hi"), "block", "node", "label", "vector", "copies")


def _pairs(unit: np.ndarray, tile: np.ndarray, diagonal: np.ndarray, block: np.ndarray, label: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows (i, j) of equal tile and label, of different blocks unless the tile is a diagonal one, with that cosine;
    rows are sorted by tile."""
    starts = np.concatenate([[0], np.flatnonzero(np.diff(tile)) + 1])
    sizes = np.diff(np.append(starts, len(tile)))
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    rows = np.repeat(sizes <= FEW, sizes)
    for step in range(1, FEW):
        i = np.flatnonzero((tile[step:] == tile[:-step]) & rows[step:])
        if not len(i):
            break
        i = i[(diagonal[i] | (block[i] != block[i + step])) & (label[i] == label[i + step])]
        i = i[np.einsum("ij,ij->i", unit[i], unit[i + step]) >= cosine]
        left.append(i)
        right.append(i + step)
    for s, n in zip(starts[sizes > FEW], sizes[sizes > FEW], strict=True):
        at = np.arange(s, s + n)
        a = at if diagonal[s] else at[block[at] == block[at].min()]
        b = at if diagonal[s] else at[block[at] != block[at].min()]
        hit = (unit[a] @ unit[b].T >= cosine) & (label[a][:, None] == label[b][None, :])
        if diagonal[s]:
            hit = np.triu(hit, 1)
        i, j = np.nonzero(hit)
        left.append(a[i])
        right.append(b[j])
    return np.concatenate(left), np.concatenate(right)


def _counts_here(i: np.ndarray, j: np.ndarray, own: np.ndarray, cell: np.ndarray) -> np.ndarray:
    """Whether each pair's least shared cell of the first table where it shares one is ``cell``; own: cells by row."""
    here, open_ = np.zeros(len(i), bool), np.arange(len(i))
    for table in range(TABLES):
        if not len(open_):
            break
        least = np.full(len(open_), np.iinfo(np.int64).max)
        shared = np.zeros(len(open_), bool)
        b = own[j[open_], table]
        for k in range(PROBES + 1):
            a = own[i[open_], table, k]
            same = (b == a[:, None]).any(1)
            least = np.where(same, np.minimum(least, a), least)
            shared |= same
        here[open_[shared]] = least[shared] == cell[open_[shared]]
        open_ = open_[~shared]
    return here


def _components(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least row that each row reaches by the pairs."""
    root = np.arange(n)
    while True:
        least = np.minimum(root[i], root[j])
        new = root.copy()
        for side in (i, j, root[i], root[j]):
            np.minimum.at(new, side, least)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def links(tiled: DataFrame, kind: str, cosine: float) -> DataFrame:
    """node, links (linked rows found in a tile), other (a node of its component in that tile); one row for each node with links
    and bundle of tiles."""

    def found(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).combine_chunks()
        cell, lo, hi, block, node, copies = (table.column(c).to_numpy() for c in ("cell", "lo", "hi", "block", "node", "copies"))
        label = label_numbers(table.column("label").to_pylist())
        new = np.concatenate([[True], (np.diff(cell) != 0) | (np.diff(lo) != 0) | (np.diff(hi) != 0)])
        tile = np.cumsum(new)
        for rows, unit in directions(table.column("vector").combine_chunks(), kind):
            i, j = _pairs(unit, tile[rows], (lo == hi)[rows], block[rows], label[rows], cosine)
            if not len(i):
                continue
            used, back = np.unique(np.concatenate([i, j]), return_inverse=True)
            i_own, j_own = back[: len(i)], back[len(i) :]
            keys = np.concatenate([cells(unit[used[at : at + BLOCK]], label[rows[used[at : at + BLOCK]]]) for at in range(0, len(used), BLOCK)])
            here = _counts_here(i_own, j_own, keys, cell[rows[i]])
            i_own, j_own = i_own[here], j_own[here]
            count = np.bincount(i_own, copies[rows[used[j_own]]], len(used)) + np.bincount(j_own, copies[rows[used[i_own]]], len(used))
            linked = np.flatnonzero(count)
            root = _components(len(used), i_own, j_own)
            arrays = [pa.array(node[rows[used[linked]]]), pa.array(count[linked].astype(np.int64)), pa.array(node[rows[used[root[linked]]]])]
            yield pa.RecordBatch.from_arrays(arrays, names=["node", "links", "other"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            while batch.num_rows:
                at = batch.num_rows
                if n + at > BUNDLE:
                    # Hand on up to the last end of a tile that is in reach, but never a part of a tile.
                    cell, lo, hi = (batch.column(c).to_numpy() for c in ("cell", "lo", "hi"))
                    ends = np.flatnonzero((np.diff(cell) != 0) | (np.diff(lo) != 0) | (np.diff(hi) != 0)) + 1
                    if held:
                        last = held[-1]
                        if any(last.column(c)[-1].as_py() != batch.column(c)[0].as_py() for c in ("cell", "lo", "hi")):
                            ends = np.concatenate([[0], ends])
                    if len(ends):
                        fit = ends[ends + n <= BUNDLE]
                        at = int(fit[-1] if len(fit) else ends[0])
                        if at:
                            held.append(batch.slice(0, at))
                        if held:
                            yield from found(held)
                        held, n, batch = [], 0, batch.slice(at)
                        continue
                held.append(batch.slice(0, at))
                n, batch = n + at, batch.slice(at)
        if held:
            yield from found(held)
        release_memory()

    keys = ["cell", "lo", "hi"]
    return tiled.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, fields(("node", "long"), ("links", "long"), ("other", "long")))


def near_duplicates(embeddings: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id of every row."""
    rows, kind = vector_rows(embeddings)
    rows = staged(rows, "lattice-rows")
    classes = rows.filter("digest IS NOT NULL").groupBy("digest").agg(F.min("row").alias("node"), F.count("*").alias("copies"), F.min("vec_id").alias("least"))
    classes = staged(classes, "lattice-classes")
    named = rows.select("row", "label", "vector").join(classes.select("node", "copies"), F.col("row") == F.col("node")).select("node", "label", "vector", "copies")
    nodes = staged(with_cells(named, kind), "lattice-nodes")

    ball = staged(balls(nodes, kind, cosine), "lattice-balls")
    tight = classes.join(ball, "node").select("node", "copies", "ball")
    ball_sizes = tight.groupBy("ball").agg(F.sum("copies").alias("all"), F.min("node").alias("other"))
    in_balls = tight.join(ball_sizes, "ball").select("node", (F.col("all") - F.col("copies")).alias("links"), "other")
    found = staged(links(tiles(nodes, ball), kind, cosine).unionByName(in_balls), "lattice-links")

    comps = connected(found.filter("node != other").select(F.col("node").alias("a"), F.col("other").alias("b")))
    per_node = found.groupBy("node").agg(F.sum("links").alias("links"))
    placed = classes.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node")).join(per_node, "node", "left")
    names = placed.groupBy("comp").agg(F.min("least").alias("component_id"))
    of_class = placed.join(names, "comp").select("digest", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    joined = rows.select("vec_id", "digest").join(of_class, "digest", "left")
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("digest").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))


def op12_lattice_dedup(spark, sf_dir: str) -> DataFrame:
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id").eqNullSafe(F.col("component_id")), F.lit(False)))
