"""Features that say something about a label, less those that say the same as an earlier one.

Relevance is |Pearson| with the label of at least a threshold; of two relevant features whose |Pearson| or |Spearman| is
over a threshold the later one in the table's order goes, unless the earlier one has gone itself. Fitted over all rows, or for each
fold over the rows of the others.

1. Values become z-scores and average ranks of their feature (both grouped aggregates), and each feature's numbers in a
   chunk of rows one packed row.
2. Features in order are cut into blocks; block i meets every block j >= i as a tile dealt by (i, j, chunk): two matrix
   products give the sums of all pairs of the tile. With one chunk of rows a tile keeps its high pairs alone; with
   more, tiles hand on their sums, which are added up over chunks.
3. The rule goes through pairs in order and is the same as: a feature stays unless an earlier neighbour stays. It is
   settled in rounds over the pairs, each of which settles all features whose earlier neighbours are settled;
   what is left in few pairs is settled in one task.

Defined results: missing values are left out of the pairs that they are in (ranks are those among a feature's own
values); a constant feature correlates with nothing, and so is not relevant; a single relevant feature stays.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import staged
from .evaluation import correlation
from .screening import running

#: Rows of a chunk, numbers in a block of features of a tile, and the largest block.
ROWS, CELLS, WIDEST = 10_000, 2_000_000, 2048
#: Pairs that one task settles.
FEW = 500_000
MOMENTS = 6


def fitted_rows(feat: DataFrame, folds: DataFrame | None) -> DataFrame:
    """``feat`` with ``scope``: -1 for all rows; with folds (pid, fold) each row once for every other fold, the one that is held out."""
    if folds is None:
        return feat.withColumn("scope", F.lit(-1))
    every = folds.agg(F.array_sort(F.collect_set("fold")).alias("_all"))  # one row
    placed = feat.join(folds.select("pid", "fold"), "pid").join(F.broadcast(every), F.lit(True))
    return placed.withColumn("scope", F.explode(F.filter("_all", lambda k: k != F.col("fold")))).drop("fold", "_all")


def prepared(rows: DataFrame) -> DataFrame:
    """scope, pid, task, feature, z, rank: values as z-scores and as average ranks, both centred; constant features go."""
    known = rows.filter(F.col("value").isNotNull() & ~F.isnan("value"))
    keys = ["scope", "feature"]
    counts = known.groupBy(*keys, "value").agg(F.count("*").alias("n"))
    ranks = running(counts, keys, "value", "n").select(*keys, "value", (F.col("before_n") + (F.col("n") + 1) / 2).alias("_rank"))
    fit = known.groupBy(*keys).agg(F.avg("value").alias("_m"), F.stddev_pop("value").alias("_s"), F.count("*").alias("_c"))
    placed = known.join(fit.filter("_s > 0"), keys).join(ranks, [*keys, "value"])
    return placed.select("scope", "pid", "task", "feature", ((F.col("value") - F.col("_m")) / F.col("_s")).alias("z"), ((F.col("_rank") - (F.col("_c") + 1) / 2) / F.col("_c")).alias("rank"))


def packed(cells: DataFrame, order: DataFrame) -> tuple[DataFrame, int, int]:
    """scope, place, chunk, rows, z, rank (arrays): one row for each feature and chunk of rows; how many rows a chunk has at most, and
    how many chunks there are."""
    keyed = staged(cells.select("pid", "task").distinct(), "redundancy-rows")
    chunks = max(1, -(-keyed.count() // ROWS))
    chunk = F.pmod(F.xxhash64("pid", "task"), F.lit(chunks)).cast("int")
    placed = keyed.withColumn("chunk", chunk).withColumn("_row", F.row_number().over(Window.partitionBy("chunk").orderBy("pid", "task")) - 1)
    most = placed.agg(F.max("_row")).first()[0] or 0
    joined = cells.join(placed, ["pid", "task"]).join(order, "feature")
    lists = F.collect_list(F.struct("_row", "z", "rank")).alias("_l")
    return joined.groupBy("scope", "place", "chunk").agg(lists).select("scope", "place", "chunk", F.col("_l._row").alias("rows"), F.col("_l.z").alias("z"), F.col("_l.rank").alias("rank")), most + 1, chunks


def pair_sums(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(MOMENTS, columns of a, columns of b): n, sums, squares and products of each two columns over the rows that both have."""
    ma, mb = ~np.isnan(a), ~np.isnan(b)
    za, zb = np.where(ma, a, 0.0), np.where(mb, b, 0.0)
    fa, fb = ma.astype(float), mb.astype(float)
    return np.stack([fa.T @ fb, za.T @ fb, fa.T @ zb, (za * za).T @ fb, fa.T @ (zb * zb), za.T @ zb])


def coefficients(s: np.ndarray) -> np.ndarray:
    """Correlations from ``pair_sums``; NaN where a side does not vary over the shared rows."""
    n, x, y, xx, yy, xy = s
    with np.errstate(invalid="ignore", divide="ignore"):
        vx, vy = xx / n - (x / n) ** 2, yy / n - (y / n) ** 2
        r = (xy / n - x / n * (y / n)) / np.sqrt(vx * vy)
    return np.where((vx > 1e-14) & (vy > 1e-14), r, np.nan)


def high_pairs(cells: DataFrame, order: DataFrame, pearson: float, spearman: float) -> DataFrame:
    """scope, i, j: places of features, i < j, whose |Pearson| or |Spearman| is over its threshold."""
    vectors, rows, chunks = packed(cells, order)
    width = int(min(WIDEST, max(32, CELLS // rows)))
    block = F.floor(F.col("place") / width).cast("int")
    vectors = staged(vectors.withColumn("own", block), "redundancy-vectors")
    last = vectors.groupBy("scope").agg(F.max("own").alias("_last"))
    placed = vectors.join(F.broadcast(last), "scope")  # a row for each fold
    first = placed.select("*", F.explode(F.sequence("own", "_last")).alias("other")).select("scope", F.col("own").alias("bi"), F.col("other").alias("bj"), "chunk", F.lit(True).alias("first"), "place", "rows", "z", "rank")
    second = placed.filter("own > 0").select("*", F.explode(F.sequence(F.lit(0), F.col("own") - 1)).alias("other")).select("scope", F.col("other").alias("bi"), F.col("own").alias("bj"), "chunk", F.lit(False).alias("first"), "place", "rows", "z", "rank")

    def side(pdf: pd.DataFrame, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        z, rank = np.full((n, len(pdf)), np.nan), np.full((n, len(pdf)), np.nan)
        for k, (at, a, b) in enumerate(zip(pdf["rows"], pdf["z"], pdf["rank"], strict=True)):
            z[at, k], rank[at, k] = a, b
        return pdf["place"].to_numpy(), z, rank

    def tile(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("place")
        n = 1 + max(int(np.max(r)) for r in pdf["rows"])
        mine = pdf["first"].to_numpy(bool)
        scope, bi, bj = (int(pdf[c].iloc[0]) for c in ("scope", "bi", "bj"))
        place, z, rank = side(pdf[mine], n)
        there, zz, rr = (place, z, rank) if bi == bj else side(pdf[~mine], n)
        sums = np.concatenate([pair_sums(z, zz), pair_sums(rank, rr)])
        keep = np.triu(np.ones(sums.shape[1:], bool), 1) if bi == bj else np.ones(sums.shape[1:], bool)
        if chunks == 1:
            with np.errstate(invalid="ignore"):
                keep &= (np.abs(coefficients(sums[:MOMENTS])) > pearson) | (np.abs(coefficients(sums[MOMENTS:])) > spearman)
        i, j = np.nonzero(keep)
        out = {"scope": scope, "i": place[i], "j": there[j]}
        out |= {f"s{k}": sums[k][i, j] if chunks > 1 else np.zeros(len(i)) for k in range(2 * MOMENTS)}
        return pd.DataFrame(out)

    sums = ", ".join(f"s{k} double" for k in range(2 * MOMENTS))
    found = first.unionByName(second).groupBy("scope", "bi", "bj", "chunk").applyInPandas(tile, f"scope int, i int, j int, {sums}")
    if chunks == 1:
        return found.select("scope", "i", "j")
    added = found.groupBy("scope", "i", "j").agg(*(F.sum(f"s{k}").alias(f"s{k}") for k in range(2 * MOMENTS)))

    def r(at: int):
        n, x, y, xx, yy, xy = (F.col(f"s{at + k}") for k in range(MOMENTS))
        vx, vy = xx / n - (x / n) ** 2, yy / n - (y / n) ** 2
        return F.when((vx > 1e-14) & (vy > 1e-14), F.abs((xy / n - x / n * (y / n)) / F.sqrt(vx * vy)))

    high = F.coalesce(r(0) > pearson, F.lit(False)) | F.coalesce(r(MOMENTS) > spearman, F.lit(False))
    return added.filter((F.col("s0") > 0) & high).select("scope", "i", "j")


def dropped(pairs: DataFrame, few: int = FEW) -> DataFrame:
    """scope, place of the features that the rule drops: those with an earlier neighbour that stays."""
    spark, gone = pairs.sparkSession, None
    left = staged(pairs, "redundancy-pairs")
    while left.count() > few:
        # Features that are in no pair as the later one stay; their later neighbours go, with all their pairs.
        later = left.select("scope", F.col("j").alias("i")).distinct()
        stay = left.select("scope", "i").distinct().join(later, ["scope", "i"], "left_anti")
        out = staged(left.join(stay, ["scope", "i"]).select("scope", F.col("j").alias("place")).distinct(), "redundancy-dropped")
        gone = out if gone is None else gone.unionByName(out)
        rest = left.join(stay, ["scope", "i"], "left_anti")
        for end in ("i", "j"):
            rest = rest.join(out.select("scope", F.col("place").alias(end)), ["scope", end], "left_anti")
        left = staged(rest.select("scope", "i", "j"), "redundancy-pairs")

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        out: set[int] = set()
        for i, j in sorted(zip(pdf["i"].tolist(), pdf["j"].tolist(), strict=True)):
            if i not in out:
                out.add(j)
        return pd.DataFrame({"scope": pd.Series([pdf["scope"].iloc[0]] * len(out), dtype="int32"), "place": pd.Series(sorted(out), dtype="int32")})

    rest = left.groupBy("scope").applyInPandas(settle, "scope int, place int")  # few pairs, counted above
    return rest if gone is None else gone.unionByName(rest)


def relevance_redundancy(feat: DataFrame, relevance: float = 0.2, pearson: float = 0.95, spearman: float = 0.95, columns: DataFrame | None = None, folds: DataFrame | None = None) -> DataFrame:
    """scope, feature of the features that stay; scope is -1, or the fold that was held out. ``columns`` (feature, place) is the order in
    which features stand in the table, that of their names where it is not given."""
    rows = fitted_rows(feat, folds)
    if columns is None:
        columns = feat.select("feature").distinct().withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("feature")) - 1)
    rel = correlation(rows, ["scope", "feature"], "value", "y", "r").filter(F.abs("r") >= relevance).select("scope", "feature")
    # Places among the relevant features of any scope, so that blocks are full.
    order = rel.select("feature").distinct().join(columns, "feature")
    order = staged(order.select("feature", (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("place")) - 1).cast("int").alias("place")), "redundancy-order")
    rel = staged(rel, "redundancy-relevant")
    cells = staged(prepared(rows.join(rel, ["scope", "feature"])), "redundancy-cells")
    out = dropped(high_pairs(cells, order, pearson, spearman))
    return rel.join(order, "feature").join(out, ["scope", "place"], "left_anti").select("scope", "feature")
