"""Derivatives and paths as window expressions over samples in order of idx."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import quaternion as Q
from .statistics import following, order, previous


def lag_difference(x: str, keys: list[str], k: int = 1, t: str = "t") -> Column:
    return F.try_divide(F.col(x) - previous(x, keys, k), F.col(t) - previous(t, keys, k))


def anchor(n: Column, shift: int, stride: int) -> Column:
    """The row whose value a row holds: blocks of ``stride`` start at 0, at shift and at n - shift, and end with
    their region."""
    i = F.col("idx")
    start = F.when(i < shift, F.lit(0)).when(i >= n - shift, n - shift).otherwise(F.lit(shift))
    return start + F.floor((i - start) / stride) * stride


def velocity(df: DataFrame, keys: list[str], x: str = "x", shift: int = 1, mode: str = "central", stride: int = 1, out: str = "v") -> DataFrame:
    """First differences over ``shift`` samples: central, or one-sided at the edges (and everywhere for the modes
    forward and backward, but at the far edge). idx counts a session's samples from 0. Sessions of fewer than 2 * shift
    samples give no rows: ``checked`` tells them."""
    n = F.count("*").over(Window.partitionBy(*keys))
    i = F.col("idx")
    ahead = F.try_divide(following(x, keys, shift) - F.col(x), following("t", keys, shift) - F.col("t"))
    back = F.try_divide(F.col(x) - previous(x, keys, shift), F.col("t") - previous("t", keys, shift))
    middle = F.try_divide(following(x, keys, shift) - previous(x, keys, shift), following("t", keys, shift) - previous("t", keys, shift))
    inner = {"central": middle, "forward": ahead, "backward": back}[mode]
    value = F.when(i < shift, ahead).when(i >= F.col("_n") - shift, back).otherwise(inner)
    made = df.withColumn("_n", n).filter(F.col("_n") >= 2 * shift).withColumn("_v", value)
    return held_by_block(made, keys, shift, stride, out)


def held_by_block(made: DataFrame, keys: list[str], shift: int, stride: int, out: str, at: Column | None = None) -> DataFrame:
    """``_v`` as ``out``, held over blocks of ``stride`` rows; ``at`` is the row whose value a row holds, where it is another."""
    if stride == 1 and at is None:
        return made.withColumn(out, F.col("_v")).drop("_n", "_v")
    held = made.withColumn("_a", anchor(F.col("_n"), shift, stride) if at is None else at)
    return held.withColumn(out, F.first("_v").over(Window.partitionBy(*keys, "_a").orderBy("idx"))).drop("_n", "_v", "_a")


def second(p0: Column, p1: Column, p2: Column, d1: Column, d2: Column) -> Column:
    """Second derivative at unevenly spaced points; zero on straight lines."""
    return F.try_divide(2 * (p0 * d2 - p1 * (d1 + d2) + p2 * d1), d1 * d2 * (d1 + d2))


def acceleration_anchor(n: Column, shift: int, stride: int) -> Column:
    """The row whose acceleration a row holds: that of ``anchor``, or where the stencil of an edge row does not fit into the session the
    row that its neighbour before holds; -1 where there is none, which stands for zero."""
    i = F.col("idx")
    fits = n - 1 - 2 * shift  # the last row from which the leading stencil fits
    lead = lambda a: F.when(fits < 0, F.lit(-1)).otherwise(F.least(a, F.floor(fits / stride) * stride))
    ahead = lead(F.floor(i / stride) * stride)
    inner = shift + F.floor((i - shift) / stride) * stride
    tail = n - shift + F.floor((i - n + shift) / stride) * stride
    before = n - shift - 1  # the row before the trailing edge
    held = F.when(before >= shift, shift + F.floor((before - shift) / stride) * stride).otherwise(lead(F.floor(before / stride) * stride))
    return F.when(i >= n - shift, F.when(tail >= 2 * shift, tail).otherwise(held)).when(i < shift, ahead).otherwise(inner).cast("long")


def acceleration(df: DataFrame, keys: list[str], x: str = "x", shift: int = 1, out: str = "a", compat: bool = False, stride: int = 1) -> DataFrame:
    """Three-point second differences; the edges use the stencil that reaches inwards, and where that does not fit they
    repeat their neighbour (zero in the first row). Sessions of no more than ``shift`` samples give no rows. ``compat`` weighs
    the leading edge as p0 (d1 + d2) - p1 d2 - p2 d1, which does not vanish on straight lines."""
    n = F.count("*").over(Window.partitionBy(*keys))

    def stencil(a: int, b: int, c: int) -> Column:
        at = lambda col, k: F.col(col) if k == 0 else F.lead(col, k).over(order(keys)) if k > 0 else F.lag(col, -k).over(order(keys))
        d1, d2 = at("t", b) - at("t", a), at("t", c) - at("t", b)
        if compat and a == 0:
            return F.try_divide(2 * (at(x, a) * (d1 + d2) - at(x, b) * d2 - at(x, c) * d1), d1 * d2 * (d1 + d2))
        return second(at(x, a), at(x, b), at(x, c), d1, d2)

    i = F.col("idx")
    value = F.when(i >= F.col("_n") - shift, stencil(-2 * shift, -shift, 0)).when(i < shift, stencil(0, shift, 2 * shift)).otherwise(stencil(-shift, 0, shift))
    made = df.withColumn("_n", n).filter(F.col("_n") > shift).withColumn("_v", value).withColumn("_at", acceleration_anchor(F.col("_n"), shift, stride))
    made = made.withColumn("_v", F.when(F.col("_at") < 0, F.lit(0.0)).otherwise(F.col("_v")))
    return held_by_block(made, keys, shift, stride, out, F.col("_at")).drop("_at")


def jerk(df: DataFrame, keys: list[str], x: str = "x", shift: int = 1, out: str = "j", stride: int = 1) -> DataFrame:
    return velocity(acceleration(df, keys, x, shift, "_acc"), keys, "_acc", shift, stride=stride, out=out).drop("_acc")


def checked(df: DataFrame, keys: list[str], shift: int, rotation: bool = False) -> tuple[DataFrame, DataFrame]:
    """The rows whose session a derivative over ``shift`` samples can take, and the sessions that it cannot: keys, reason (the first
    that holds of: too short, repeated time, zero quaternion), n. Both come from the same marked rows, dealt and sorted as
    the derivative itself needs them."""
    own, every = order(keys), Window.partitionBy(*keys)
    marked = df.withColumn("_n", F.count("*").over(every)).withColumn("_still", (F.col("t") <= F.lag("t").over(own)).cast("int"))
    still = F.coalesce(F.max("_still").over(every), F.lit(0)) > 0
    reason = F.when(F.col("_n") < 2 * shift, "too short").when(still, "repeated time")
    if rotation:
        size = sum((F.col(c) ** 2 for c in ("qy", "qz", "qw")), F.col("qx") ** 2)
        reason = reason.when(F.max((F.coalesce(size, F.lit(0.0)) == 0).cast("int")).over(every) > 0, "zero quaternion")
    marked = marked.withColumn("_reason", reason)
    rejects = marked.filter("_reason IS NOT NULL").groupBy(*keys, F.col("_reason").alias("reason")).agg(F.count("*").alias("n"))
    return marked.filter("_reason IS NULL").select(*df.columns), rejects


def quaternion(df: DataFrame) -> DataFrame:
    return df.withColumn("q", Q.quat(*(F.col(c) for c in ("qx", "qy", "qz", "qw"))))


def angular_velocity(df: DataFrame, keys: list[str], shift: int = 1) -> DataFrame:
    """wx, wy, wz: rotation vector of inverse(q_i) * q_j over its time; central, one-sided at the edges."""
    n = F.count("*").over(Window.partitionBy(*keys))
    at = lambda c, k: F.lead(c, k).over(order(keys)) if k > 0 else F.lag(c, -k).over(order(keys)) if k < 0 else F.col(c)
    base = quaternion(df).withColumn("_n", n).filter(F.col("_n") >= 2 * shift)
    i = F.col("idx")
    pick = lambda c: (F.when(i < shift, at(c, 0)).otherwise(at(c, -shift)), F.when(i >= F.col("_n") - shift, at(c, 0)).otherwise(at(c, shift)))
    (qa, qb), (ta, tb) = pick("q"), pick("t")
    made = base.select("*", qa.alias("_qa"), qb.alias("_qb"), (tb - ta).alias("_dt")).withColumn("_r", Q.rotation_vector(Q.times(Q.inverse(F.col("_qa")), F.col("_qb"))))
    return made.select(*df.columns, *(F.try_divide(F.col("_r")[c], F.col("_dt")).alias(f"w{c}") for c in "xyz"))


def time_step(keys: list[str], t: str = "t") -> Column:
    """Time for a step of one sample: half the way between both neighbours, at the ends to the only one."""
    before, after = previous(t, keys), following(t, keys)
    return (F.coalesce(after, F.col(t)) - F.coalesce(before, F.col(t))) / F.when(before.isNotNull() & after.isNotNull(), 2.0).otherwise(1.0)


def savitzky_golay(df: DataFrame, keys: list[str], x: str = "x", half: int = 2, deriv: int = 1, out: str = "sg", per_time: bool = True) -> DataFrame:
    """Derivative of the quadratic fitted to 2 * half + 1 samples around each row, as weighed sums of its neighbours; rows within ``half`` of an edge use the polynomial of the first or last whole window. With
    ``per_time`` it is divided by ``time_step`` once, for either derivative."""
    base = df.withColumn("_n", F.count("*").over(Window.partitionBy(*keys))).filter(F.col("_n") >= 2 * half + 1)
    centre = F.least(F.greatest(F.col("idx"), F.lit(half)), F.col("_n") - 1 - half)
    m, places = 2 * half + 1, range(-half, half + 1)
    s2, s4 = sum(k * k for k in places), sum(k**4 for k in places)
    # Weights of the neighbours are fixed numbers, so nothing depends on how far into the session a row lies.
    at = lambda k: F.col(x) if k == 0 else F.lead(x, k).over(order(keys)) if k > 0 else F.lag(x, -k).over(order(keys))
    weighed = lambda w: sum((F.lit(float(w(k))) * at(k) for k in places if k != -half), F.lit(float(w(-half))) * at(-half))
    fits = base.withColumn("_b", weighed(lambda k: k / s2)).withColumn("_c", weighed(lambda k: (m * k * k - s2) / (m * s4 - s2 * s2)))
    i = F.col("idx")
    every = Window.partitionBy(*keys)
    edge = lambda c, row: F.max(F.when(i == row, F.col(c))).over(every)
    pick = lambda c: F.when(i < half, edge(c, F.lit(half))).when(i >= F.col("_n") - half, edge(c, F.col("_n") - 1 - half)).otherwise(F.col(c))
    value = pick("_b") + 2 * pick("_c") * (i - centre) if deriv == 1 else 2 * pick("_c")
    value = F.try_divide(value, time_step(keys)) if per_time else value
    return fits.withColumn(out, value).drop("_n", "_b", "_c")


def angular_rate(df: DataFrame, keys: list[str]) -> DataFrame:
    """wx, wy, wz: rotation vector from each row's predecessor over the time between; no row for the first."""
    base = quaternion(df).select("*", previous("q", keys).alias("_q"), (F.col("t") - previous("t", keys)).alias("_dt"))
    made = base.filter("_q IS NOT NULL").withColumn("_r", Q.rotation_vector(Q.times(Q.inverse(F.col("_q")), F.col("q"))))
    return made.select(*df.columns, *(F.try_divide(F.col("_r")[c], F.col("_dt")).alias(f"w{c}") for c in "xyz"))


def smoothed_rate(df: DataFrame, keys: list[str], half: int = 2, deriv: int = 1) -> DataFrame:
    """keys, idx, sx, sy, sz: ``angular_rate`` smoothed sample by sample; the first row repeats the second."""
    rate = angular_rate(df, keys).withColumn("idx", F.col("idx") - 1)
    for c in "xyz":
        rate = savitzky_golay(rate, keys, f"w{c}", half, deriv, out=f"s{c}", per_time=False)
    rate = rate.select(*keys, (F.col("idx") + 1).alias("idx"), "sx", "sy", "sz")
    return rate.unionByName(rate.filter("idx = 1").withColumn("idx", F.lit(0).cast("long")))


def step_lengths(df: DataFrame, keys: list[str]) -> Column:
    """Distance to the previous position."""
    return F.sqrt(sum(((F.col(c) - previous(c, keys)) ** 2 for c in ("py", "pz")), (F.col("px") - previous("px", keys)) ** 2))


def path_summary(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys, total path, net displacement, efficiency (0 if still), bounding box volume."""
    grouped = df.withColumn("_s", step_lengths(df, keys)).groupBy(*keys)
    end = lambda c: F.max_by(c, "idx") - F.min_by(c, "idx")
    net = F.sqrt(end("px") * end("px") + end("py") * end("py") + end("pz") * end("pz"))
    total = F.coalesce(F.sum("_s"), F.lit(0.0))
    side = lambda c: F.max(c) - F.min(c)
    return grouped.agg(total.alias("total"), net.alias("net"), F.coalesce(F.try_divide(net, total), F.lit(0.0)).alias("efficiency"), (side("px") * side("py") * side("pz")).alias("box"))


def reversals(df: DataFrame, keys: list[str], seconds: float | None = None) -> DataFrame:
    """keys, n, per_second: turns of more than a right angle between neighbouring steps, of the first ``seconds`` alone where
    they are given."""
    d = {c: F.col(c) - previous(c, keys) for c in ("px", "py", "pz")}
    moved = df.select(*keys, "idx", "t", *(v.alias(f"d{c}") for c, v in d.items()))
    turn = sum((F.col(f"d{c}") * previous(f"d{c}", keys) for c in ("py", "pz")), F.col("dpx") * previous("dpx", keys))
    turned = moved.withColumn("_turn", turn)
    if seconds is not None:
        turned = turned.withColumn("_t0", F.min("t").over(Window.partitionBy(*keys))).filter(F.col("t") <= F.col("_t0") + seconds)
    grouped = turned.groupBy(*keys)
    return grouped.agg(F.count_if(F.col("_turn") < 0).alias("n"), F.try_divide(F.count_if(F.col("_turn") < 0), F.max("t") - F.min("t")).alias("per_second"))


def opposing(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys, value: backward movement after the fastest step, along the direction from the start to there."""
    moved = df.withColumn("_s", step_lengths(df, keys)).select("*", *((following(c, keys) - F.col(c)).alias(f"n{c}") for c in ("px", "py", "pz")))
    top = moved.groupBy(*keys).agg(
        F.max_by("idx", F.struct("_s", -F.col("idx"))).alias("_top"), *(F.max_by(c, F.struct("_s", -F.col("idx"))).alias(f"t{c}") for c in ("px", "py", "pz")), *(F.min_by(c, "idx").alias(f"s{c}") for c in ("px", "py", "pz"))
    )
    way = {c: F.col(f"t{c}") - F.col(f"s{c}") for c in ("px", "py", "pz")}
    size = F.sqrt(sum((v * v for v in list(way.values())[1:]), way["px"] * way["px"]))
    along = F.try_divide(sum((F.col(f"n{c}") * way[c] for c in ("py", "pz")), F.col("npx") * way["px"]), size)
    return moved.join(top, keys).groupBy(*keys).agg(F.coalesce(F.sum(F.when((F.col("idx") >= F.col("_top")) & (along < 0), -along)), F.lit(0.0)).alias("value"))


def rotation_total(df: DataFrame, keys: list[str]) -> DataFrame:
    q = quaternion(df)
    return q.withColumn("_g", Q.geodesic(F.col("q"), previous("q", keys))).groupBy(*keys).agg(F.sum("_g").alias("value"))


#: Samples of a block of a segment whose pairs are taken tile by tile: where angles are summed, and where they are rows.
PAIR_BLOCK, TILE = 256, 1024


def sample_pairs(df: DataFrame, keys: list[str], block: int = TILE) -> DataFrame:
    """keys, i, j, angle: all pairs of samples i < j of a segment with their geodesic distance. A segment is cut into blocks of
    ``block`` samples; block a meets every block b >= a as a tile of its own, dealt by (segment, a, b), so a long segment is spread
    over tasks and each sample is sent once for each block. The pairs are as many as the segment has. Tiles are dealt to a fixed
    number of tasks: their work is that of the pairs, not of the few bytes that are sent."""
    q = quaternion(df).select(*keys, F.col("idx").alias("i"), "q", F.floor(F.col("idx") / block).alias("_a"))
    ends = q.groupBy(*keys).agg(F.min("_a").alias("_lo"), F.max("_a").alias("_hi"))
    left = q.join(ends, keys).select(*keys, "i", "q", "_a", F.explode(F.sequence("_a", "_hi")).alias("_b"))
    right = q.join(ends, keys).select(*keys, F.col("i").alias("j"), F.col("q").alias("_q"), F.explode(F.sequence("_lo", "_a")).alias("_a"), F.col("_a").alias("_b"))
    tile = [*keys, "_a", "_b"]
    dealt = left.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *tile)
    return dealt.join(right, tile).filter(F.col("i") < F.col("j")).select(*keys, "i", "j", Q.geodesic(F.col("q"), F.col("_q")).alias("angle"))


def pair_dispersion(df: DataFrame, keys: list[str], block: int = PAIR_BLOCK) -> DataFrame:
    """keys, value, n_pairs: mean geodesic distance over all pairs of samples of a whole segment. Angles are summed tile by tile (a
    block with a block) in Arrow batches, so what is sent on is a sum and a count for each tile, never a pair."""
    source = df.select(*keys, "idx", "qx", "qy", "qz", "qw").withColumn("_a", F.floor(F.col("idx") / block).cast("long"))
    ends = source.groupBy(*keys).agg(F.min("_a").alias("_lo"), F.max("_a").alias("_hi"))
    placed = source.join(ends, keys)
    # Each sample goes to the tiles of its block: as the first of (own, b) and as the second of (a, own).
    first = placed.select(*keys, "qx", "qy", "qz", "qw", F.col("_a").alias("_i"), F.explode(F.sequence("_a", "_hi")).alias("_j"), F.lit(True).alias("_first"))
    second = placed.filter("_a > _lo").select(*keys, "qx", "qy", "qz", "qw", F.explode(F.sequence("_lo", F.col("_a") - 1)).alias("_i"), F.col("_a").alias("_j"), F.lit(False).alias("_first"))
    kinds = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)

    def tile(pdf: pd.DataFrame) -> pd.DataFrame:
        q = pdf[["qx", "qy", "qz", "qw"]].to_numpy(float)
        size = np.linalg.norm(q, axis=1, keepdims=True)
        q = np.divide(q, size, out=np.zeros_like(q), where=size > 0)
        own = pdf["_first"].to_numpy(bool)
        same = pdf["_i"].iloc[0] == pdf["_j"].iloc[0]
        angle = 2 * np.arccos(np.minimum(1.0, np.abs(q[own] @ (q[own] if same else q[~own]).T)))
        angle = angle[np.triu_indices(len(angle), 1)] if same else angle.ravel()
        out = pdf[keys].head(1).copy()
        out["_sum"], out["_n"] = float(angle.sum()), len(angle)
        return out

    tiles = first.unionByName(second).groupBy(*keys, "_i", "_j").applyInPandas(tile, f"{kinds}, _sum double, _n long")
    return tiles.groupBy(*keys).agg(F.try_divide(F.sum("_sum"), F.sum("_n")).alias("value"), F.sum("_n").alias("n_pairs")).filter("n_pairs > 0")


#: Pairs of axes of the distances of two objects.
AXIS_PAIRS = ("xx", "xy", "xz", "yy", "yz", "zz")


def object_pairs(df: DataFrame, keys: list[str], pairs: list[tuple[str, str]]) -> DataFrame:
    """keys, idx, pair, axes, x: distances of two objects at the same sample, in space (axes: xyz) and between an axis of the first and
    one of the second. ``df`` has a row for each object of a sample: keys, object, idx, px, py, pz."""
    spots = F.map_from_entries(F.collect_list(F.struct("object", F.struct("px", "py", "pz"))))
    wide = df.groupBy(*keys, "idx").agg(spots.alias("_at"))
    each = wide.select(*keys, "idx", F.explode(F.array(*(F.struct(F.lit(f"{a}-{b}").alias("pair"), F.try_element_at("_at", F.lit(a)).alias("a"), F.try_element_at("_at", F.lit(b)).alias("b")) for a, b in pairs))).alias("p"))
    each = each.select(*keys, "idx", "p.*").filter("a IS NOT NULL AND b IS NOT NULL")
    space = F.sqrt(sum(((F.col(f"a.p{c}") - F.col(f"b.p{c}")) ** 2 for c in "yz"), (F.col("a.px") - F.col("b.px")) ** 2))
    flat = [F.struct(F.lit("xyz").alias("axes"), space.alias("x")), *(F.struct(F.lit(c).alias("axes"), F.abs(F.col(f"a.p{c[0]}") - F.col(f"b.p{c[1]}")).alias("x")) for c in AXIS_PAIRS)]
    return each.select(*keys, "idx", "pair", F.explode(F.array(*flat)).alias("d")).select(*keys, "idx", "pair", "d.*")


def adaptive_filter(df: DataFrame, keys: list[str], least: float = 0.05, most: float = 0.5, slow: float = 0.5, fast: float = 5.0) -> DataFrame:
    """Recursive smoothing of quaternions: each output lies between the last one and the sample. The share of the
    way is ``least`` for turns up to ``slow`` degrees, ``most`` from ``fast`` degrees on, and linear between. The
    first row is kept as measured; a zero quaternion counts as the last output. Recursive within a session,
    parallel across sessions; columns sx to sw."""
    schema = ", ".join([*(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys), "idx long, sx double, sy double, sz double, sw double"])
    low, high = np.deg2rad(slow), np.deg2rad(fast)

    def smooth(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx")
        q = pdf[["qx", "qy", "qz", "qw"]].to_numpy()
        out = np.empty_like(q)
        out[:1] = q[:1]
        for k in range(1, len(q)):
            last, own = out[k - 1], q[k] if np.linalg.norm(q[k]) else out[k - 1]
            sizes = np.linalg.norm(last) * np.linalg.norm(own)
            turn = 2 * np.arccos(min(1.0, abs(float(last @ own)) / sizes)) if sizes else 0.0
            share = least + (most - least) * min(1.0, max(0.0, (turn - low) / (high - low)))
            out[k] = between(last, own, share)
        got = pdf[[*keys, "idx"]].copy()
        got[["sx", "sy", "sz", "sw"]] = out
        return got

    return df.groupBy(*keys).applyInPandas(smooth, schema)


def between(a: np.ndarray, b: np.ndarray, share: float) -> np.ndarray:
    """Unit quaternion at a share of the shorter way from a to b; on the chord where they all but agree."""
    a, b = (v / (np.linalg.norm(v) or 1.0) for v in (a, b))
    cos = float(a @ b)
    b, cos = (-b, -cos) if cos < 0 else (b, cos)
    if cos > 0.9995:
        mixed = a + share * (b - a)
    else:
        turn = np.arccos(cos)
        mixed = (np.sin((1 - share) * turn) * a + np.sin(share * turn) * b) / np.sin(turn)
    return mixed / (np.linalg.norm(mixed) or 1.0)


def hull_volume(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys, value: volume of the convex hull of positions, null under four points or in a plane. The hull of a
    group is that of its parts' hulls: each task keeps only the corners of its own points before they meet."""
    schema = ", ".join([*(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys), "value double"])

    def volume(pdf: pd.DataFrame) -> pd.DataFrame:
        out = pdf[keys].head(1).copy()
        out["value"] = convex_volume(pdf[["px", "py", "pz"]].dropna().to_numpy())
        return out

    points = df.select(*keys, "px", "py", "pz")

    def corners(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for _, own in part.groupby(keys, dropna=False):
                yield own[hull_corners(own[["px", "py", "pz"]].to_numpy())]

    return points.mapInPandas(corners, points.schema).groupBy(*keys).applyInPandas(volume, schema)


def hull_corners(points: np.ndarray) -> np.ndarray:
    """True for the points that may be corners of the hull; all of them where there is no solid hull."""
    solid = ~np.isnan(points).any(1)
    faces = hull_faces(points[solid])
    if faces is None:
        return np.ones(len(points), bool)
    kept = {tuple(v) for v in faces.reshape(-1, 3).tolist()}
    return np.array([tuple(v) in kept for v in points.tolist()], bool)


def convex_volume(points: np.ndarray) -> float | None:
    faces = hull_faces(points)
    if faces is None:
        return None
    tri = faces - faces.reshape(-1, 3).mean(0)
    return float(abs(np.einsum("ij,ij->i", tri[:, 0], np.cross(tri[:, 1], tri[:, 2])).sum()) / 6)


def hull_faces(points: np.ndarray) -> np.ndarray | None:
    """Outward triangles (n, 3, 3) of the hull, None under four points or in a plane. Incremental: a point outside
    replaces the faces that it sees."""
    p = np.unique(points, axis=0)
    if len(p) < 4:
        return None
    a = p[0]
    b = p[np.argmax(((p - a) ** 2).sum(1))]
    c = p[np.argmax((np.cross(b - a, p - a) ** 2).sum(1))]
    normal = np.cross(b - a, c - a)
    d = p[np.argmax(np.abs((p - a) @ normal))]
    scale = np.abs(p - p.mean(0)).max() or 1.0
    if abs((d - a) @ normal) <= 1e-12 * scale**3:
        return None
    middle = (a + b + c + d) / 4

    def outward(x, y, z):
        n = np.cross(y - x, z - x)
        return (x, y, z) if (x - middle) @ n > 0 else (x, z, y)

    faces = [outward(a, b, c), outward(a, b, d), outward(a, c, d), outward(b, c, d)]
    for v in p:
        tri = np.array(faces)
        n = np.cross(tri[:, 1] - tri[:, 0], tri[:, 2] - tri[:, 0])
        seen = ((v - tri[:, 0]) * n).sum(1) > 1e-12 * scale**3
        if not seen.any():
            continue
        edges: dict = {}
        for f in tri[seen]:
            for x, y in ((f[0], f[1]), (f[1], f[2]), (f[2], f[0])):
                edges[(tuple(x), tuple(y))] = (x, y)
        faces = [tuple(f) for f in tri[~seen]] + [(x, y, v) for (kx, ky), (x, y) in edges.items() if (ky, kx) not in edges]
    return np.array(faces)
