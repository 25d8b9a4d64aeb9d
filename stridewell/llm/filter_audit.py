"""How the filters of a corpus act on each other: what each removes in every order they can be applied in.

1. One pass over the bytes of every text. Each byte has a class (``CLASSES``); a table of two states, outside and
   inside a word, tells for state and class what to count (``COUNTS``): a word begins, a code point begins, a capital,
   a symbol. The state after a byte follows from its class alone (``NEXT``), so all bytes of a batch look up the table
   at once. Where a word ends its span goes into a hash table of open addresses; a slot's span is compared byte by
   byte before a word counts as seen, so distinct words are exact whatever their hashes.
2. A digest of 32 bytes (SHA-256) stands for the text; the least doc_id of each digest tells repeated texts.
3. Documents are counted by part and by the set of filters they fail, and every order is worked out from those few
   counts: what a filter removes depends only on the set of filters before it.

Defined results: a null text is empty (no words: fails A, neither B nor C nor D); a null lang is the part ''; documents
without doc_id are no one's earlier text and have none; rows that share a doc_id count each, and do not make each other
repeats; labels that repeat a doc_id count as 1 where any row does; an empty table has no parts, so no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fields, release_memory, staged, texts

FILTERS = "ABCDE"
LEAST_WORDS = 200
DISTINCT_PERCENT = 50
CAPITAL_PERCENT = 3
SYMBOLS = "#$%&*|"
#: Bytes of text that pass the table at once; a longer text passes alone.
BLOCK = 1 << 20
#: Words up to so many bytes are hashed and compared eight bytes at a time, longer ones one by one.
SHORT = 64

SPACE, CAPITAL, SYMBOL, PLAIN, FOLLOWS = range(5)
#: The class of each byte; bytes 80-BF follow the first byte of a code point.
CLASSES = np.full(256, PLAIN, np.uint8)
CLASSES[[0x20, *range(0x09, 0x0E)]] = SPACE
CLASSES[ord("A") : ord("Z") + 1] = CAPITAL
CLASSES[[ord(c) for c in SYMBOLS]] = SYMBOL
CLASSES[0x80:0xC0] = FOLLOWS
OUTSIDE, INSIDE = 0, 1
#: The state after a byte of each class.
NEXT = np.array([OUTSIDE, INSIDE, INSIDE, INSIDE, INSIDE], np.uint8)
BEGINS, POINT, IS_CAPITAL, IS_SYMBOL, ENDS = 1, 2, 4, 8, 16
#: What to count, by state and class.
COUNTS = np.array(
    [
        [POINT, BEGINS | POINT | IS_CAPITAL, BEGINS | POINT | IS_SYMBOL, BEGINS | POINT, BEGINS],
        [POINT | ENDS, POINT | IS_CAPITAL, POINT | IS_SYMBOL, POINT, 0],
    ],
    np.uint8,
)
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: By length in bytes, the bytes of a word's last eight that belong to it.
_TAIL = np.array([0] + [(1 << (8 * k)) - 1 for k in range(1, 9)], np.uint64)


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place of ``data`` on as one number; data ends with eight spare bytes."""
    return np.ndarray((len(data) - 7,), np.dtype("<u8"), data, 0, (1,))


def _hashes(data: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    eights, found = _eights(data), length.astype(np.uint64) * _MIX
    rows, at = np.arange(len(begin)), 0
    long = np.flatnonzero(length > SHORT)
    with np.errstate(over="ignore"):
        while True:
            rows = rows[(length[rows] > at) & (length[rows] <= SHORT)]
            if not len(rows):
                break
            piece = eights[begin[rows] + at] & _TAIL[np.minimum(length[rows] - at, 8)]
            mixed = (found[rows] ^ piece) * _MIX
            found[rows] = mixed ^ (mixed >> np.uint64(29))
            at += 8
    for r in long:
        found[r] = xxhash.xxh3_64_intdigest(data[begin[r] : begin[r] + length[r]])
    return found


def _same(data: np.ndarray, begin: np.ndarray, length: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the spans a[i] and b[i], of equal length, hold the same bytes."""
    eights, same = _eights(data), np.ones(len(a), bool)
    rows, at = np.flatnonzero(length[a] <= SHORT), 0
    while len(rows):
        size = length[a[rows]] - at
        mask = _TAIL[np.minimum(size, 8)]
        equal = (eights[begin[a[rows]] + at] & mask) == (eights[begin[b[rows]] + at] & mask)
        same[rows[~equal]] = False
        rows, at = rows[equal & (size > 8)], at + 8
    for r in np.flatnonzero(length[a] > SHORT):
        same[r] = np.array_equal(data[begin[a[r]] : begin[a[r]] + length[a[r]]], data[begin[b[r]] : begin[b[r]] + length[b[r]]])
    return same


def first_spans(data: np.ndarray, begin: np.ndarray, length: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """True on one span of each distinct word of each owner. All spans look for a place at once: those that find their
    slot free take it (one of several wins), those that find their own word there are repeats, the rest go on."""
    first = np.zeros(len(begin), bool)
    if not len(begin):
        return first
    bits = max(4, int(2 * len(begin) - 1).bit_length())
    slots = np.full(1 << bits, -1, np.int64)
    with np.errstate(over="ignore"):
        hashed = (_hashes(data, begin, length) ^ (owner.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))) * _MIX
    place = (hashed >> np.uint64(64 - bits)).astype(np.int64)
    rest = np.arange(len(begin))
    while len(rest):
        free = rest[slots[place[rest]] < 0]
        slots[place[free]] = free
        there = slots[place[rest]]
        own = there == rest
        first[rest[own]] = True
        rest, there = rest[~own], there[~own]
        alike = (hashed[rest] == hashed[there]) & (owner[rest] == owner[there]) & (length[rest] == length[there])
        at = np.flatnonzero(alike)
        alike[at] = _same(data, begin, length, rest[at], there[at])
        rest = rest[~alike]
        place[rest] = (place[rest] + 1) & (len(slots) - 1)
    return first


def transduce(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Counts of the texts data[offsets[i]:offsets[i + 1]]; data ends with eight spare bytes. Each text begins outside a
    word, and the byte after its last ends its last word."""
    n, size = len(offsets) - 1, int(offsets[-1])
    kind = CLASSES[data[:size]]
    state = np.zeros(size, np.uint8)
    state[1:] = NEXT[kind[:-1]]
    texts_at = offsets[:-1][np.diff(offsets) > 0]
    state[texts_at] = OUTSIDE
    seen = COUNTS[state, kind]
    begin = np.flatnonzero(seen & BEGINS)
    # A word ends before the space that follows it, or with its text.
    stop = np.flatnonzero(seen & ENDS)
    ends = offsets[1:][np.diff(offsets) > 0]
    open_ = NEXT[kind[ends - 1]] == INSIDE
    stop = np.sort(np.concatenate([stop, ends[open_]]))
    owner = np.searchsorted(offsets, begin, side="right") - 1
    first = first_spans(data, begin, stop - begin, owner)
    of = lambda mask: np.bincount(np.searchsorted(offsets, np.flatnonzero(mask), side="right") - 1, minlength=n)
    return {
        "n_words": np.bincount(owner, minlength=n),
        "n_distinct": np.bincount(owner[first], minlength=n),
        "n_capitals": of(seen & IS_CAPITAL),
        "n_chars": np.diff(offsets) - of((seen & POINT) == 0),
        "n_symbols": of(seen & IS_SYMBOL),
    }


COUNTED = ("n_words", "n_distinct", "n_capitals", "n_chars", "n_symbols")


def counted(docs: DataFrame) -> DataFrame:
    """doc_id, part, the counts of each whole text and its digest. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("text").cast(pa.large_binary())
            raw = np.frombuffer(column.buffers()[2] or b"", np.uint8)
            offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
            at = 0
            while at < len(column):
                to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BLOCK, side="right")) - 1)
                own = offsets[at : to + 1] - offsets[at]
                data = np.zeros(int(own[-1]) + 8, np.uint8)
                data[: own[-1]] = raw[offsets[at] : offsets[to]]
                got, view = transduce(data, own), memoryview(data)
                digests = [hashlib.sha256(view[a:b]).digest() for a, b in zip(own[:-1].tolist(), own[1:].tolist(), strict=True)]
                arrays = [batch.column("doc_id")[at:to], batch.column("part")[at:to], *(pa.array(got[c], pa.int64()) for c in COUNTED), pa.array(digests, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "part", *COUNTED, "digest"])
                at = to
        release_memory()

    shape = fields(("doc_id", "long"), ("part", "string"), *((c, "long") for c in COUNTED), ("digest", "binary"))
    source = docs.withColumn("lang", F.coalesce(F.col("lang").cast("string"), F.lit("")))
    return texts(source, F.col("lang").alias("part")).mapInArrow(run, shape)


def own_failures() -> F.Column:
    """Bits of the filters A to D that the counts of a document fail."""
    words, capitals = F.col("n_words"), 100 * F.col("n_capitals")
    fails = (words < LEAST_WORDS, 100 * F.col("n_distinct") < DISTINCT_PERCENT * words, capitals > CAPITAL_PERCENT * F.col("n_chars"), F.col("n_symbols") > 0)
    return sum((F.when(f, F.lit(1 << k)).otherwise(F.lit(0)) for k, f in enumerate(fails)), F.lit(0))


def patterns(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask (bits of the filters that fail), and of such documents: n, good, toxic."""
    own = staged(counted(docs).select("doc_id", "part", own_failures().alias("mask"), "digest"), "audit-documents")
    marked = labels.groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    marked = marked.filter("_id IS NOT NULL")
    # Rows without doc_id have no label and stay where they are.
    named = own.filter("doc_id IS NOT NULL").join(marked, F.col("doc_id") == F.col("_id"), "left").drop("_id")
    rows = named.unionByName(own.filter("doc_id IS NULL").withColumns({"good": F.lit(0), "toxic": F.lit(0)})).fillna(0, ["good", "toxic"])
    kinds = ["digest", "part", "mask", "good", "toxic"]
    # By document first, so that a text that very many share is summed where it is read.
    each = rows.groupBy("doc_id", *kinds).agg(F.count("*").alias("n"))
    of = each.groupBy(*kinds).agg(F.sum("n").alias("n"), F.min("doc_id").alias("first"), F.min_by("n", "doc_id").alias("n_first"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("n_null"))
    # A text has a row here for each kind of its documents, few however many share it.
    both = of.withColumn("least", F.min("first").over(Window.partitionBy("digest")))
    # Of the rows of a kind, those of the text's least doc_id and those without any are no repeats.
    fresh = F.col("n_null") + F.when(F.col("first") == F.col("least"), F.col("n_first")).otherwise(0)
    split = F.explode(F.array(F.struct(F.col("mask").alias("m"), fresh.alias("n")), F.struct((F.col("mask") + (1 << 4)).alias("m"), (F.col("n") - fresh).alias("n"))))
    flat = both.select("part", "good", "toxic", split.alias("s")).select("part", "good", "toxic", F.col("s.m").alias("mask"), F.col("s.n").alias("n"))
    return flat.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))


def interactions(found: DataFrame, filters: str = FILTERS) -> DataFrame:
    """part, filter_order, step and what that step keeps, removes and loses. ``found`` has a row for each part and set of
    failed filters at most, so each part is at most 2^n rows here."""
    spark, k = found.sparkSession, len(filters)
    found = staged(found, "audit-patterns")
    # What a filter does after a set of others: the same in every order that begins with that set.
    combos = [(before, f) for before in range(1 << k) for f in range(k) if not before >> f & 1]
    weight = {before: factorial(bin(before).count("1")) * factorial(k - 1 - bin(before).count("1")) for before in range((1 << k) - 1)}
    literal = F.explode(F.array(*(F.struct(F.lit(b).alias("before"), F.lit(f).alias("f"), F.lit(1 << f).alias("bit"), F.lit(weight[b]).cast("long").alias("weight")) for b, f in combos))).alias("c")
    dealt = found.select("*", literal).select("part", "mask", "n", "good", "toxic", "c.*")
    fails, gone = F.col("mask").bitwiseAND(F.col("bit")) > 0, F.col("mask").bitwiseAND(F.col("before")) > 0
    add = lambda cond, what: F.sum(F.when(cond, F.col(what)).otherwise(F.lit(0))).cast("long")
    by_set = dealt.groupBy("part", "before", "f").agg(
        add(~fails & ~gone, "n").alias("kept"),
        add(fails & ~gone, "n").alias("removed"),
        add(fails & gone, "n").alias("redundant"),
        add(F.col("mask") == F.col("bit"), "n").alias("unique_fails"),
        add(fails & ~gone, "good").alias("good_lost"),
        add(fails & ~gone, "toxic").alias("toxic_lost"),
        F.first("weight").alias("weight"),
    )
    shapley = by_set.groupBy("part", "f").agg(F.sum(F.col("removed") * F.col("weight")).cast("long").alias("shapley"))
    orders = ["".join(p) for p in permutations(filters)]
    steps = [(o, s + 1, sum(1 << filters.index(c) for c in o[:s]), filters.index(o[s])) for o in orders for s in range(k)]
    steps = F.broadcast(spark.createDataFrame(steps, "filter_order string, step int, before int, f int"))  # n! n rows
    return by_set.drop("weight").join(shapley, ["part", "f"]).join(steps, ["before", "f"]).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def op11_filter_audit(spark, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return interactions(patterns(docs, labels))
