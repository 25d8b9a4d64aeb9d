"""Hard negatives: for each anchor and each of its nearest rows of the same label, the best rows of other labels whose score lies
in a window under that positive's score.

1. Rows are ordered by label and by their place on a Hilbert curve through a projection of their directions, cut into blocks of
   ``BLOCK`` rows of one label and written as Parquet. Each block carries its zone map, the least and largest value of
   each dimension. The order breaks ties by row, so that equal vectors spread over blocks like any others.
2. Anchors that follow each other on the curve form chunks. For a chunk and the zone maps, interval arithmetic gives the
   least and largest score that each anchor can have with a row of each block; blocks that no anchor's windows can meet
   are not read (``plan``).
3. What is left is read: (chunk, some blocks) are groups of bounded size. In a group blocks come in the order of their bounds, and
   an anchor leaves out those whose bound is under the worst of its best rows so far. Scores are exact whole numbers.
4. Positives come first, by one open window that begins at the score of the anchor's own block; their scores then
   set the windows of the negatives.

Defined results: rows whose label or vector is null, whose vector is empty or holds null or non-finite components take no part;
vectors of different lengths never meet; rows that share a vec_id are rows of their own, also as anchors; a null vec_id is no
anchor and comes last among ties; components beyond 2^62 count as that, and scores beyond 64 bits as the largest such
number. Tables without rows or anchors give none.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fields, release_memory, staged, workers_import_this

POSITIVES, NEGATIVES = 5, 3
LEAST_PERCENT, MOST_PERCENT = 50, 95
#: Rows of a block, blocks whose anchors form a chunk at most, anchors of a chunk on average at least, zone maps of a page, blocks of
#: a group that is read.
BLOCK, CHUNK, ANCHORS, PAGE, GROUP = 256, 128, 1024, 512, 64
#: Dimensions of the curve and bits of each.
AXES, BITS = 8, 7
NONE = -(1 << 62)
LARGEST = (1 << 63) - 1


def curve_places(x: np.ndarray, bits: int) -> np.ndarray:
    """The place of each row of whole numbers (axes x bits, 62 at most) on the Hilbert curve: undo the turns of each
    level from the top, then read the bits as a Gray code."""
    x, n = x.astype(np.int64).copy(), x.shape[1]
    level = 1 << (bits - 1)
    while level > 1:
        low = level - 1
        for i in range(n):
            high = (x[:, i] & level) > 0
            swap = np.where(high, 0, (x[:, 0] ^ x[:, i]) & low)
            x[:, 0] ^= np.where(high, low, swap)
            x[:, i] ^= swap
        level >>= 1
    for i in range(1, n):
        x[:, i] ^= x[:, i - 1]
    turn = np.zeros(len(x), np.int64)
    level = 1 << (bits - 1)
    while level > 1:
        turn ^= np.where(x[:, n - 1] & level, level - 1, 0)
        level >>= 1
    x ^= turn[:, None]
    place = np.zeros(len(x), np.int64)
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            place = place << 1 | (x[:, i] >> bit & 1)
    return place


@lru_cache(8)
def _projection(dim: int) -> np.ndarray:
    return np.random.default_rng(11).normal(size=(dim, AXES))


def curve(points: np.ndarray) -> np.ndarray:
    """Places on the curve of the directions of vectors: projections within three standard deviations, in 2^BITS steps."""
    x = points.astype(np.float64)
    x = x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-300)
    steps = np.floor((np.clip(x @ _projection(x.shape[1]), -3, 3) + 3) / 6 * (1 << BITS))
    return curve_places(np.clip(steps, 0, (1 << BITS) - 1), BITS)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers: in double precision where that is exact, else one by one."""
    if not len(a) or not len(b):
        return np.zeros((len(a), len(b)), np.int64)
    if float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < 2**53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    exact = a.astype(object) @ b.T.astype(object)
    return np.clip(exact, NONE + 1, LARGEST).astype(np.int64)


def bounds(a: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds on the inner products of each row of a with any vector between ``least`` and ``most``, row by row of those; widened
    by what double precision can lose."""
    a, least, most = a.astype(np.float64), least.astype(np.float64), most.astype(np.float64)
    up, down = np.maximum(a, 0), np.minimum(a, 0)
    slack = np.abs(a) @ np.maximum(np.abs(least), np.abs(most)).T * 1e-12
    return up @ least.T + down @ most.T - slack, up @ most.T + down @ least.T + slack


def whole_points(embeddings: DataFrame, label: Column, anchor: Column, scale: float) -> DataFrame:
    """row, vec_id, label, anchor, size, place on the curve and point (whole numbers as bytes) of each row that takes part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, points = [], []
            for k, v in enumerate(batch.column("embedding").to_pylist()):
                if v and None not in v:
                    with np.errstate(over="ignore", invalid="ignore"):
                        x = np.array(v, np.float64)
                        y = np.floor(scale * x)
                    if np.isfinite(x).all():
                        keep.append(k)
                        points.append(np.clip(y, NONE, -NONE).astype(np.int64))
            place = np.zeros(len(keep), np.int64)
            sizes = np.array([len(p) for p in points], np.int64)
            for n in np.unique(sizes):
                rows = np.flatnonzero(sizes == n)
                place[rows] = curve(np.stack([points[r] for r in rows]))
            own = batch.take(pa.array(keep, pa.int64()))
            arrays = [*(own.column(c) for c in ("row", "vec_id", "label", "anchor")), pa.array(sizes.astype(np.int32)), pa.array(place), pa.array([p.tobytes() for p in points], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["row", "vec_id", "label", "anchor", "size", "place", "point"])

    workers_import_this(embeddings.sparkSession)
    source = embeddings.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"), F.col("embedding").cast("array<double>").alias("embedding"))
    return source.filter("label IS NOT NULL").mapInArrow(run, fields(("row", "long"), ("vec_id", "long"), ("label", "long"), ("anchor", "boolean"), ("size", "int"), ("place", "long"), ("point", "binary")))


def _matrix(column) -> np.ndarray:
    raw = column.to_pylist()
    return np.frombuffer(b"".join(raw), "<i8").reshape(len(raw), -1)


def blocks(points: DataFrame) -> DataFrame:
    """block, pos, vec_id, label, size, point, anchor; ``seed`` of an anchor: the score of the last of its best ``POSITIVES`` rows
    in its own block; on the last row of a block its zone map, ``least`` and ``most``."""
    names = ["block", "pos", "vec_id", "label", "size", "point", "anchor", "seed", "least", "most"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0

        def closed(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            nonlocal n
            t = pa.Table.from_batches(held).combine_chunks()
            x, count = _matrix(t.column("point")), t.num_rows
            own = np.flatnonzero(t.column("anchor").to_numpy())
            seeds: list = [None] * count
            if count > POSITIVES and len(own):
                score = products(x[own], x)
                score[np.arange(len(own)), own] = NONE
                for k, s in zip(own, np.sort(score, axis=1)[:, -POSITIVES], strict=True):
                    seeds[k] = int(s)
            block, last = TaskContext.get().partitionId() << 32 | n, [None] * (count - 1)
            n += 1
            arrays = [pa.array(np.full(count, block)), pa.array(np.arange(count, dtype=np.int32)), *(t.column(c).combine_chunks() for c in ("vec_id", "label", "size", "point", "anchor"))]
            arrays = [a.combine_chunks() if isinstance(a, pa.ChunkedArray) else a for a in arrays]
            zone = [pa.array([*last, v.tobytes()], pa.binary()) for v in (x.min(0), x.max(0))]
            return pa.RecordBatch.from_arrays([*arrays, pa.array(seeds, pa.int64()), *zone], names=names)

        held: list[pa.RecordBatch] = []
        for batch in batches:
            label, size = batch.column("label").to_numpy(), batch.column("size").to_numpy()
            at = 0
            while at < batch.num_rows:
                if held and (held[-1].column("label")[-1].as_py(), held[-1].column("size")[-1].as_py()) != (label[at], size[at]):
                    yield closed(held)
                    held = []
                room = BLOCK - sum(b.num_rows for b in held)
                to = min(at + room, batch.num_rows)
                other = np.flatnonzero((label[at:to] != label[at]) | (size[at:to] != size[at]))
                to = at + int(other[0]) if len(other) else to
                held.append(batch.slice(at, to - at))
                at = to
                if sum(b.num_rows for b in held) == BLOCK:
                    yield closed(held)
                    held = []
        if held:
            yield closed(held)
        release_memory()

    order = ["label", "size", "place", "row"]
    shape = fields(("block", "long"), ("pos", "int"), ("vec_id", "long"), ("label", "long"), ("size", "int"), ("point", "binary"), ("anchor", "boolean"), ("seed", "long"), ("least", "binary"), ("most", "binary"))
    return staged(points.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, shape), "negatives-blocks")


def chunked(anchors: DataFrame) -> DataFrame:
    """``anchors`` with ``chunk``: those of some blocks that follow each other in a partition, or where a partition has few anchors those of
    some partitions that follow each other. Every chunk meets the blocks that it needs by itself, so chunks are not to be many."""
    part = F.shiftright("block", 32)
    n, last = anchors.agg(F.count("*"), F.max(part)).first()
    per = max(1, (last or 0) + 1 if not n else -(-((last or 0) + 1) * ANCHORS // n))
    own = F.shiftright(F.col("block").bitwiseAND(F.lit((1 << 32) - 1)), CHUNK.bit_length() - 1) if per == 1 else F.lit(0)
    return anchors.withColumn("chunk", F.shiftleft(F.floor(part / per).cast("long"), 32) + own)


Windows = Callable[[pa.Table], tuple[np.ndarray, np.ndarray]]


def open_window(anchors: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """One window for each anchor, from its seed on."""
    lo = np.array([NONE if s is None else s for s in anchors.column("seed").to_pylist()], np.int64)[:, None]
    return lo, np.full_like(lo, LARGEST)


def windows_below(anchors: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """For each anchor the windows under the scores of its positives; none (an empty one) where it has fewer."""
    lo, hi = np.ones((anchors.num_rows, POSITIVES), np.int64), np.zeros((anchors.num_rows, POSITIVES), np.int64)
    for k, scores in enumerate(anchors.column("scores").to_pylist()):
        for w, s in enumerate(scores):
            lo[k, w], hi[k, w] = -(-LEAST_PERCENT * s // 100), MOST_PERCENT * s // 100
    return lo, hi


def _related(a_label, a_size, b_label, b_size, same: bool) -> np.ndarray:
    return ((a_label[:, None] == b_label[None, :]) == same) & (a_size[:, None] == b_size[None, :])


def plan(anchors: DataFrame, zones: DataFrame, windows: Windows, same: bool) -> DataFrame:
    """chunk, block: the blocks that may hold a row for a window of one of the chunk's anchors."""
    pages = F.lit(max(1, -(-zones.count() // PAGE)))
    dealt = anchors.withColumn("page", F.explode(F.sequence(F.lit(0), pages - 1)))
    chunks = anchors.select(F.col("chunk").alias("chunk")).distinct()  # a column of its own, as both sides are dealt by it
    maps = chunks.withColumn("page", F.explode(F.sequence(F.lit(0), pages - 1))).join(zones.withColumn("page", F.pmod(F.xxhash64("block"), pages)), "page")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        needed = set()
        if left.num_rows and right.num_rows:
            lo, hi = windows(left)
            a_label, a_size = left.column("label").to_numpy(), left.column("size").to_numpy()
            b_label, b_size, block = right.column("label").to_numpy(), right.column("size").to_numpy(), right.column("block").to_numpy()
            met = _related(a_label, a_size, b_label, b_size, same)
            for n in np.unique(b_size):
                a, b = np.flatnonzero(a_size == n), np.flatnonzero(b_size == n)
                if len(a):
                    down, up = bounds(_matrix(left.column("point").take(a)), _matrix(right.column("least").take(b)), _matrix(right.column("most").take(b)))
                    reach = np.zeros(up.shape, bool)
                    for w in range(lo.shape[1]):
                        reach |= (up >= lo[a, w][:, None]) & (down <= hi[a, w][:, None]) & (lo[a, w] <= hi[a, w])[:, None]
                    needed.update(block[b[(reach & met[np.ix_(a, b)]).any(0)]].tolist())
        chunk = left.column("chunk")[0].as_py() if left.num_rows else None
        return pa.table({"chunk": pa.array([chunk] * len(needed), pa.int64()), "block": pa.array(sorted(needed), pa.int64())})

    return dealt.groupBy("chunk", "page").cogroup(maps.groupBy("chunk", "page")).applyInArrow(run, "chunk long, block long")


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest scores of each row, and their ids; ids ascend, so the first of equal ones has the least. NONE is no score."""
    score = score.copy()
    rows, out, found = np.arange(len(score)), np.full((len(score), k), NONE), np.full((len(score), k), LARGEST)
    for r in range(min(k, score.shape[1])):
        at = score.argmax(1)
        out[:, r] = score[rows, at]
        found[:, r] = np.where(out[:, r] == NONE, LARGEST, ids[at])
        score[rows, at] = NONE
    return out, found


def read(anchors: DataFrame, rows: DataFrame, planned: DataFrame, n_blocks: int, windows: Windows, same: bool, k: int) -> DataFrame:
    """block, pos (an anchor), window, score, vec_id: the best k rows of each window of each anchor, rank from 1."""
    salts = F.lit(max(1, -(-n_blocks // GROUP)))
    # Columns of its own, as anchors come from the same table.
    own = rows.select(*(F.col(c).alias(c) for c in ("block", "pos", "label", "size", "point")), F.coalesce("vec_id", F.lit(LARGEST)).alias("vec_id"))
    dealt = planned.join(own, "block").withColumn("salt", F.pmod(F.xxhash64("block"), salts))
    asked = anchors.join(planned.select("chunk", F.pmod(F.xxhash64("block"), salts).alias("salt")).distinct(), "chunk")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        n = left.num_rows
        columns = {c: left.column(c).to_numpy() for c in ("block", "pos", "label", "size")}
        lo, hi = windows(left) if n else (np.zeros((0, 1), np.int64),) * 2
        best, ids = np.full((n, lo.shape[1], k), NONE), np.full((n, lo.shape[1], k), LARGEST)
        right = right.sort_by([("block", "ascending"), ("vec_id", "ascending")]) if right.num_rows else right
        block = right.column("block").to_numpy()
        starts = np.flatnonzero(np.diff(block, prepend=-1)) if right.num_rows else []
        parts = []
        for start, stop in zip(starts, [*starts[1:], len(block)], strict=True):
            part = right.slice(start, stop - start)
            label, size = part.column("label")[0].as_py(), part.column("size")[0].as_py()
            a = np.flatnonzero(((columns["label"] == label) == same) & (columns["size"] == size))
            if len(a):
                x = _matrix(part.column("point"))
                down, up = (b[:, 0] for b in bounds(_matrix(left.column("point").take(a)), x.min(0)[None], x.max(0)[None]))
                parts.append((float(up.max()), int(block[start]), a, down, up, x, part))
        for _, name, a, down, up, x, part in sorted(parts, key=lambda p: (-p[0], p[1])):
            floor = np.maximum(lo[a], best[a, :, -1])
            wanted = ((up[:, None] >= floor) & (down[:, None] <= hi[a]) & (lo[a] <= hi[a])).any(1)
            a = a[wanted]
            if not len(a):
                continue
            score = products(_matrix(left.column("point").take(a)), x)
            if same:
                home = np.flatnonzero(columns["block"][a] == name)
                pos = part.column("pos").to_numpy()
                place = np.empty(len(pos), np.int64)
                place[pos] = np.arange(len(pos))
                score[home, place[columns["pos"][a[home]]]] = NONE
            vec_id = part.column("vec_id").to_numpy()
            for w in range(lo.shape[1]):
                inside = (score >= lo[a, w][:, None]) & (score <= hi[a, w][:, None])
                if inside.any():
                    got, got_ids = _best(np.where(inside, score, NONE), vec_id, k)
                    both, both_ids = np.concatenate([best[a, w], got], 1), np.concatenate([ids[a, w], got_ids], 1)
                    order = np.lexsort((both_ids, -both))[:, :k]
                    best[a, w], ids[a, w] = np.take_along_axis(both, order, 1), np.take_along_axis(both_ids, order, 1)
        i, w, r = np.nonzero(best > NONE)
        out = {"block": columns["block"][i], "pos": columns["pos"][i].astype(np.int32), "window": w.astype(np.int32), "score": best[i, w, r], "vec_id": ids[i, w, r]}
        return pa.table({c: pa.array(v) for c, v in out.items()})

    found = asked.groupBy("chunk", "salt").cogroup(dealt.groupBy("chunk", "salt")).applyInArrow(run, "block long, pos int, window int, score long, vec_id long")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("block", "pos", "window").orderBy(F.desc("score"), "vec_id")))
    return ranked.filter(F.col("rank") <= k).withColumn("vec_id", F.when(F.col("vec_id") < LARGEST, F.col("vec_id")))


def mine(points: DataFrame) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score from ``whole_points``."""
    rows = blocks(points)
    zones = rows.filter("least IS NOT NULL").select("block", "label", "size", "least", "most")
    n_blocks = zones.count()
    anchors = rows.filter("anchor").select("block", "pos", "vec_id", "label", "size", "point", "seed")
    anchors = staged(chunked(anchors), "negatives-anchors")
    same = staged(plan(anchors, zones, open_window, True), "negatives-plan")
    positives = staged(read(anchors, rows, same, n_blocks, open_window, True, POSITIVES).drop("window"), "negatives-positives")

    scores = positives.groupBy("block", "pos").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "score"))), lambda s: s["score"]).alias("scores"))
    asking = staged(anchors.drop("seed").join(scores, ["block", "pos"]), "negatives-anchors")
    others = staged(plan(asking, zones, windows_below, False), "negatives-plan")
    negatives = read(asking, rows, others, n_blocks, windows_below, False, NEGATIVES)

    of = positives.select("block", "pos", (F.col("rank") - 1).alias("window"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    named = anchors.select("block", "pos", F.col("vec_id").alias("anchor_id"))
    both = negatives.select("block", "pos", "window", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")).join(of, ["block", "pos", "window"]).join(named, ["block", "pos"])
    return both.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def op13_hard_negatives(spark, sf_dir: str) -> DataFrame:
    embeddings = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.coalesce(F.col("vec_id") % 7 == 0, F.lit(False)), (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(whole_points(embeddings, label, F.col("vec_id") % 50 == 0, 256.0))
