"""Near-duplicate documents by bottom-k sketches.

1. Every text becomes its set of word shingles (64-bit hashes of one hash function), a digest of the whole set
   and a sketch: the k smallest hashes. Texts with equal sets are one class, a node, from here on.
2. Inverted lists of retained values: from each node's sketch the values that the fewest sketches hold are
   listed, as many as two sketches of similar sets cannot all miss (the prefix principle: if two sketches of
   k values share at least o, they share one of the k - o + 1 rarest). A passage that a third of all
   documents share is common and so is not listed where a document has rarer values. With each value goes its
   place in that order: two members of a list whose values from there on are too few to reach the overlap do
   not meet.
3. Each list's most central member (the one whose values are the most shared, so a group's original rather than
   an edited copy) meets the others; what that links forms first components. Then the members outside a
   list's main component meet all others of the list with a like size. So a group of n near copies costs a few
   n pairs, not n^2, and no link between two components is left out.
4. The sketch of the union of two sets is the k smallest values of both sketches together; the share of it
   that both hold estimates their similarity, and pairs clearly below the threshold go.
5. The rest is verified on the full sets, and components are formed.

The overlap asked for in 2 and 4 is exact for sets that fit a sketch. For larger ones it lies five standard
deviations under its mean at the threshold (126 of K = 192): a pair there is missed with a chance of
three in ten million.

Defined results: without words or text the set is empty and linked with nothing; fewer words than a shingle
make one shingle of all; rows that share a doc_id are one node if their sets are equal; a null doc_id is no
component's name unless nothing else is there; very long texts are handled whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fields, free_name, small, staged, texts, tidy

WORDS = 5
PERCENT = 80
K = 192
#: Words, and digests of sets, that a task remembers before it starts anew.
REMEMBERED = 300_000
#: Halves of sketch values that two sets may lose by being equal within a set.
SLACK = 2
#: Values before a listed one that go with it.
BEFORE = 4
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))

_shared: dict = {}


def forget() -> None:
    """Drops what this Python worker has remembered."""
    _shared.clear()


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingles(text: bytes, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``size`` words; bytes.lower lowers A-Z only and
    bytes.split parts at the space and \\t \\n \\v \\f \\r."""
    words = _shared.setdefault("words", _Words())
    split = text.lower().split()
    if not split:
        return np.zeros(0, np.int64)
    h = np.fromiter(map(words.__getitem__, split), np.uint64, len(split))
    n = max(1, len(h) - size + 1)
    run = np.full(n, size if len(h) >= size else len(h), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(min(size, len(h))):
            run = (run ^ h[k : k + n]) * MIX[0]
            run ^= run >> np.uint64(29)
        run *= MIX[1]
    return np.unique((run ^ run >> np.uint64(32)).view(np.int64))


def sketches(docs: DataFrame, size: int = WORDS, k: int = K) -> DataFrame:
    """doc_id, n_shingles, set (16 bytes that equal sets share) and sketch of each text; the sketch is null where
    the task has met the set before. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[bytes] = set()
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                sets = [shingles(t, size) for t in batch.column("text").cast(pa.binary()).to_pylist()]
                digests = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
                kept = []
                for s, digest in zip(sets, digests, strict=True):
                    kept.append(None if digest in met else s[:k])
                    met.add(digest)
                if len(met) > REMEMBERED:
                    met.clear()
                columns = [batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array(kept, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "set", "sketch"])

    return texts(docs).mapInArrow(tidy(run, forget), fields(("doc_id", "long"), ("n_shingles", "long"), ("set", "binary"), ("sketch", "array<long>")))


def least_overlap(percent: int, k: int) -> int:
    """Values that the sketches of similar sets of more than k values share, five standard deviations down."""
    share = percent / 100
    return int(k * share - 5 * sqrt(k * share * (1 - share))) + 1


def _ceil(dividend: Column, divisor: int) -> Column:
    """Upwards rounded quotient of whole numbers."""
    return ((dividend + (divisor - 1)) / divisor).cast("long")


def overlap_needed(n: Column, percent: int, k: int) -> Column:
    """Least overlap of the sketch of a set of n shingles with that of any similar set: exact while all
    similar sets fit a sketch, else the statistical bound."""
    return F.when(100 * n < percent * k, _ceil(n * percent, 100)).otherwise(F.least(F.lit(least_overlap(percent, k)).cast("long"), n))


def pair_overlap(na: Column, nb: Column, percent: int, k: int) -> Column:
    """Least overlap of the sketches of two similar sets of these sizes."""
    exact = _ceil((na + nb) * percent, 100 + percent)
    return F.when((na <= k) & (nb <= k), exact).otherwise(F.greatest(overlap_needed(na, percent, k), overlap_needed(nb, percent, k)))


def inverted_lists(sketched: DataFrame, members: DataFrame, percent: int, k: int) -> DataFrame:
    """value, node, n, left, central, before: the listed values of each node that another sketch holds too. ``left``
    counts the node's shared values from this one on, ``central`` is the mean logarithm of how many hold its
    values, ``before`` the listed values just before this one."""
    values = sketched.filter(F.col("sketch").isNotNull()).select("row", F.explode("sketch").alias("value"))
    common = values.groupBy("value").agg(F.count("*").alias("df")).filter("df > 1")
    # Values that one sketch alone holds come first in the order and match nothing: count them, not list them.
    # Dealt by row first: buffers of lists would take twice the room of plain rows on their way.
    shared = values.join(common, "value").repartition("row").groupBy("row").agg(F.array_sort(F.collect_list(F.struct("df", "value"))).alias("shared"))
    n, held = F.col("n"), F.least(F.col("n"), F.lit(k))
    own = F.greatest(F.lit(0), overlap_listed(n, percent, k) - (held - F.size("shared"))).cast("int")
    central = F.aggregate("shared", F.lit(0.0), lambda total, s: total + F.log(s["df"].cast("double"))) / held
    nodes = members.filter("n > 0").select("node", "n")
    values = F.transform(F.slice("shared", 1, own), lambda s: s["value"])
    listed = nodes.join(shared, nodes["node"] == shared["row"]).select("node", "n", F.size("shared").alias("size"), central.alias("central"), values.alias("values"))
    before = F.slice("values", F.greatest(F.col("pos") - BEFORE + 1, F.lit(1)), F.least(F.col("pos"), F.lit(BEFORE)))
    each = listed.select("node", "n", "size", "central", "values", F.posexplode("values").alias("pos", "value"))
    return each.select("value", "node", "n", (F.col("size") - F.col("pos")).cast("long").alias("left"), "central", before.alias("before"))


def overlap_listed(n: Column, percent: int, k: int) -> Column:
    """Values of a sketch, rarest first, of which similar sets cannot miss all."""
    return F.least(n, F.lit(k)) - overlap_needed(n, percent, k) + 1


def may_be_similar(percent: int, k: int) -> Column:
    """Members a and b of a list: their sizes and the values they have left allow the overlap."""
    alike = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
    return alike & (F.least("la", "lb") >= pair_overlap(F.col("na"), F.col("nb"), percent, k))


def head_pairs(lists: DataFrame, percent: int, k: int) -> DataFrame:
    """Distinct pairs (a < b) of the most central member of each list with its others."""
    heads = lists.groupBy("value").agg(F.max(F.struct("central", "node", "n", "left")).alias("head"), F.count("*").alias("c")).filter("c > 1")
    heads = heads.select("value", F.col("head.node").alias("a"), F.col("head.n").alias("na"), F.col("head.left").alias("la"))
    others = lists.select("value", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("left").alias("lb"))
    met = others.join(heads, (others["value"] == heads["value"]) & (F.col("a") != F.col("b")) & may_be_similar(percent, k))
    return in_order(met).distinct()


def in_order(pairs: DataFrame) -> DataFrame:
    swap = F.col("a") > F.col("b")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.when(swap, F.col("nb")).otherwise(F.col("na")).alias("na"), F.when(swap, F.col("na")).otherwise(F.col("nb")).alias("nb"))


def rest_pairs(lists: DataFrame, components: DataFrame, percent: int, k: int) -> DataFrame:
    """Distinct pairs (a < b) of list members in different components. In each list the component with most
    members is its main one; every other member meets all members, in bands of sizes that can be similar."""
    placed = lists.join(components, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    sizes = placed.groupBy("value", "comp").agg(F.count("*").alias("c"))
    main = sizes.groupBy("value").agg(F.max(F.struct("c", "comp")).alias("m"), F.count("*").alias("comps")).filter("comps > 1").select("value", F.col("m.comp").alias("main"))
    mixed = placed.join(main, "value")
    # Similar sizes are at most one band apart.
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100 / percent)) + 1e-9).cast("int")
    few = mixed.filter(F.col("comp") != F.col("main")).select("value", F.explode(F.array(band - 1, band, band + 1)).alias("band"), F.col("node").alias("a"), F.col("n").alias("na"), F.col("left").alias("la"), F.col("comp").alias("ca"), F.col("before").alias("before_a"))
    every = mixed.select("value", band.alias("band"), F.col("node").alias("b"), F.col("n").alias("nb"), F.col("left").alias("lb"), F.col("comp").alias("cb"), "main", F.col("before").alias("before_b"))
    # Two that share a value just before this one have met there already.
    once = ((F.col("cb") == F.col("main")) | (F.col("a") < F.col("b"))) & ~F.arrays_overlap("before_a", "before_b")
    same = (few["value"] == every["value"]) & (few["band"] == every["band"])
    met = few.join(every, same & (F.col("ca") != F.col("cb")) & may_be_similar(percent, k) & once)
    return in_order(met).distinct()


def estimated(pairs: DataFrame, sets: DataFrame, percent: int, k: int) -> DataFrame:
    """Pairs (a, b) whose union sketch does not rule them out. Sketches come as the upper halves of their values, in the
    same order; SLACK makes up for halves that are equal by chance. Row by row in the JVM: sketches are wide, and
    an Arrow batch would hold thousands of them."""
    own = sets.select("node", "sketch")
    both = pairs.join(own.toDF("a", "sa"), "a").join(own.toDF("b", "sb"), "b")
    # The intersection keeps the order of the first sketch, which is sorted.
    both = both.select("a", "b", "na", "nb", F.array_intersect("sa", "sb").alias("common"), F.slice(F.array_sort(F.array_union("sa", "sb")), 1, F.lit(k)).alias("union"))
    shared, common = F.size(F.array_intersect("common", "union")) + SLACK, F.size("common") + SLACK
    exact = 100 * common >= percent * (F.col("na") + F.col("nb") - common)
    whole = (F.col("na") <= k) & (F.col("nb") <= k)
    return both.filter(F.when(whole, exact).otherwise(shared >= F.least(F.lit(least_overlap(percent, k)), F.size("union")))).select("a", "b")


def listed_sets(docs: DataFrame, lists: DataFrame, members: DataFrame, size: int, k: int) -> DataFrame:
    """node, sketch (upper halves of the values) and full set of the nodes in ``lists``. Texts are read again for them alone, found by
    doc_id; as rows may share one, their sets are told apart by digest."""
    wanted = staged(members.join(lists.select("node").distinct(), "node", "left_semi").select("least_id", "set", "node"), "dedup-wanted")
    ids = wanted.select(F.col("least_id").alias("_id")).distinct()

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                sets = [shingles(t, size) for t in whole.slice(at, 64).column("text").cast(pa.binary()).to_pylist()]
                digests = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
                first = list({d: i for i, d in enumerate(digests)}.values())
                columns = [pa.array([digests[i] for i in first], pa.binary()), pa.array([(sets[i][:k] >> 32).astype(np.int32) for i in first], pa.list_(pa.int32())), pa.array([sets[i] for i in first], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["digest", "sketch", "full"])

    source = texts(docs)
    rows = source.join(small(ids), source["doc_id"].eqNullSafe(F.col("_id")), "left_semi").select("text")
    sets = rows.mapInArrow(tidy(full, forget), fields(("digest", "binary"), ("sketch", "array<int>"), ("full", "array<long>")))
    known = small(wanted.select("set", "node"))
    found = staged(sets.join(known, sets["digest"] == known["set"]).select("node", "sketch", "full"), "dedup-sets")
    # Rows that repeat a doc_id and its set are few, mostly none; only then are sets moved to drop them.
    repeated = not found.groupBy("node").count().filter("count > 1").isEmpty()
    return staged(found.dropDuplicates(["node"]), "dedup-sets") if repeated else found


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a written table) whose full sets are similar; row by row in the JVM, as full sets may be very long.
    Sets of nodes in no pair stay where they are."""
    nodes = small(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    own = sets.select("node", "full").join(nodes, "node", "left_semi")
    both = pairs.join(own.toDF("a", "fa"), "a").join(own.toDF("b", "fb"), "b")
    common = both.select("a", "b", F.size("fa").alias("na"), F.size("fb").alias("nb"), F.size(F.array_intersect("fa", "fb")).alias("common"))
    return common.filter(100 * F.col("common").cast("long") >= percent * (F.col("na") + F.col("nb") - F.col("common")).cast("long")).select("a", "b")


def connected(links: DataFrame) -> DataFrame:
    """node, comp: the least node that each node of ``links`` (a, b) reaches. Labels fall to the least among
    neighbours, then to their label's label, until none changes; each round is a written table."""
    edges = staged(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "dedup-edges")
    labels = staged(edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("comp")), "dedup-labels")
    while True:
        seen = edges.join(labels.toDF("b", "label"), "b").groupBy("a").agg(F.min("label").alias("m"))
        fallen = labels.join(seen, labels["node"] == seen["a"]).select("node", F.least("comp", "m").alias("c"), F.col("comp").alias("old"))
        jumped = fallen.join(labels.toDF("c", "cc"), "c", "left").select("node", F.least("c", F.coalesce("cc", "c")).alias("comp"), (F.least("c", F.coalesce("cc", "c")) != F.col("old")).alias("changed"))
        new = staged(jumped, "dedup-labels")
        labels = new.select("node", "comp")
        if new.filter("changed").isEmpty():
            return labels


def components(docs: DataFrame, size: int = WORDS, percent: int = PERCENT, k: int = K) -> DataFrame:
    """doc_id, n_shingles, component_id of every row; ``set``, equal for equal sets; and ``keep``, true on the
    rows that stand for their component: a component_id alone names several where a doc_id has several sets."""
    # A node is named by the least row, numbered as written, that has its sketch.
    sketched = staged(sketches(docs, size, k).withColumn("row", F.monotonically_increasing_id()), "dedup-sketches")
    named = F.when(F.col("sketch").isNotNull(), F.col("row"))
    members = sketched.groupBy("set").agg(F.min("doc_id").alias("least_id"), F.max("n_shingles").alias("n"), F.min(named).alias("node"))
    members = staged(members, "dedup-nodes")
    lists = staged(inverted_lists(sketched, members, percent, k), "dedup-lists")
    sets = listed_sets(docs, lists, members, size, k)

    likely = staged(estimated(head_pairs(lists, percent, k), sets, percent, k), "dedup-pairs")
    first = staged(verified(likely, sets, percent), "dedup-links")
    likely = staged(estimated(rest_pairs(lists, connected(first), percent, k), sets, percent, k), "dedup-pairs")
    comps = connected(first.unionByName(verified(likely, sets, percent)))

    placed = members.join(comps, "node", "left").select("set", "least_id", F.coalesce("comp", "node").alias("comp"))
    by_id = F.struct(F.col("least_id").isNull(), "least_id", "set")
    least = placed.groupBy("comp").agg(F.min("least_id").alias("component_id"), F.min_by("set", by_id).alias("first_set"))
    by_set = placed.join(least, "comp").select("set", "component_id", (F.col("set") == F.col("first_set")).alias("is_first"))
    joined = sketched.select("doc_id", "n_shingles", "set").join(by_set, "set")
    empty = F.col("n_shingles") == 0
    return joined.select(
        "doc_id",
        "n_shingles",
        F.when(empty, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        "set",
        (empty | (F.col("is_first") & F.col("doc_id").eqNullSafe(F.col("component_id")))).alias("keep"),
    )


def keep_documents(docs: DataFrame, size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One document of each group, the one with the least doc_id (and of its texts the one whose set has the
    least digest), with all its columns. Documents without words are groups of their own. Rows are told apart
    by doc_id and set: different texts under one doc_id, or without one, are different documents; rows that
    share both stay once, the one with the least text."""
    id_, set_, kept_ = (free_name(docs, x) for x in ("kept_id", "kept_set", "kept_digest"))
    rows = staged(components(docs, size, percent).select("doc_id", "set", "keep"), "dedup-rows")
    ids = rows.groupBy(F.col("doc_id").alias(id_)).agg((F.count("*") > 1).alias("several"), F.max("keep").alias("keep")).filter("several OR NOT keep")
    ids = staged(ids, "dedup-ids")
    # Few ids have several rows, so a written table of them alone is joined without dealing the documents.
    several = staged(ids.filter("several AND keep").select(id_), "dedup-several")
    kept = rows.filter("keep").join(several, F.col("doc_id").eqNullSafe(F.col(id_)), "left_semi").select(F.col("doc_id").alias(id_), F.col("set").alias(kept_)).distinct()

    @F.pandas_udf("binary")
    def digest(column):
        found = column.map(lambda t: xxhash.xxh3_128_digest(shingles(t.encode(), size).tobytes()))
        forget()
        return found

    own = docs["doc_id"].cast("long")
    # Those that go, and those that are looked at row by row, are fewer than those that stay: while they are few the documents are not dealt.
    one = docs.join(small(ids.select(id_)), own.eqNullSafe(F.col(id_)), "left_anti")
    many = docs.join(several, own.eqNullSafe(F.col(id_)), "left_semi").withColumn(set_, digest(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    many = many.join(kept, many["doc_id"].cast("long").eqNullSafe(F.col(id_)) & (F.col(set_) == F.col(kept_)), "left_semi")
    plain = [f.name for f in docs.schema.fields if isinstance(f.dataType, T.AtomicType)]
    row = F.min_by(F.struct(*docs.columns), F.struct("text", F.xxhash64(*plain))).alias("row")
    return one.unionByName(many.groupBy(F.col("doc_id").cast("long").alias(id_), set_).agg(row).select("row.*"))


def op2_minhash_dedup(spark, sf_dir: str) -> DataFrame:
    out = components(spark.read.parquet(f"{sf_dir}/documents.parquet"), size=2)
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id").eqNullSafe(F.col("component_id")), F.lit(False)).alias("kept"))
