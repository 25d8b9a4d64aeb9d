"""SpotSigs fingerprints (Theobald, Siddharth and Paepcke 2008).

A signature is an anchor (a common word of the text's language) with the next CHAIN content words after it; the
last anchors of a text have the content words that are left, one at least. A text's fingerprint is the set of
its signatures, each a 32-bit hash, written as sorted hexadecimal numbers. In a text without any signature each
word counts as an anchor, with the words that are left after it, if any; a text without words has a
signature of its own, so no fingerprint of a text with characters is empty.

Two fingerprints are compared by Jaccard similarity. ``near_pairs`` partitions sets by length: sets whose
lengths differ by more than the threshold cannot be alike, so they never meet, and within a partition only sets
that share one of their rarest signatures do.

Defined results: a null text is an empty one; the empty fingerprint is like itself (1) and unlike any other
(0); equal texts have equal fingerprints; repeated rows are done one by one; order between rows of one doc_id
is by text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fields, texts, tidy

CHAIN = 3
REMEMBERED = 600_000
MARKS = ".,;:!?\"'()[]{}<>|*#$%&-_/\\`~+=@^…«»„“”‚‘’–—"
#: Anchors, common words of English, French, German and Spanish.
ANCHORS = frozenset(
    """a an and are as at be by for from has have he in is it of on or that the this to was were will with
    au aux avec ce dans de des du elle en est et il la le les mais ne par pas pour que qui sur un une
    auch auf aus bei das dem den der die ein eine er es ich im ist mit nicht sich sie sind und von zu
    al como con del el ella esta las lo los no para pero por se ser su una y""".split()
)
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
BUCKET_DOCS = 2_000
#: Most buckets, as their bounds go to the driver; beyond, buckets hold more rows, which are sorted with spill.
BUCKETS = 200_000

_shared: dict = {}


def forget() -> None:
    """Drops what this Python worker has remembered."""
    _shared.clear()


class _Words(dict):
    """Hash of a word without marks in lower case; odd for anchors, even for content, 0 for nothing."""

    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        bare = word.strip(MARKS).lower()
        value = 0
        if bare:
            value = xxhash.xxh3_64_intdigest(bare.encode("utf-8", "surrogatepass")) | 3
            value = value if bare in ANCHORS else value - 1
        self[word] = value
        return value


def signatures(text: str, chain: int = CHAIN) -> np.ndarray:
    """Sorted distinct 32-bit signatures of a text."""
    words = _shared.setdefault("words", _Words())
    split = text.split()
    h = np.fromiter(map(words.__getitem__, split), np.uint64, len(split))
    h = h[h != 0]
    if not len(h):
        return np.array([xxhash.xxh32_intdigest(text.encode("utf-8", "surrogatepass"))], np.uint32) if text else np.zeros(0, np.uint32)
    content = np.flatnonzero(~h & np.uint64(1))
    anchors = np.flatnonzero(h & np.uint64(1))
    anchors = anchors[np.searchsorted(content, anchors) < len(content)]
    if not len(anchors):
        content = anchors = np.arange(len(h))
    first = np.searchsorted(content, anchors, side="right")
    with np.errstate(over="ignore"):
        sig = h[anchors] * MIX[0]
        for k in range(chain):
            there = np.flatnonzero(first + k < len(content))
            sig[there] = (sig[there] ^ h[content[first[there] + k]]) * MIX[1]
    return np.unique((sig >> np.uint64(32)).astype(np.uint32))


def written(sig: np.ndarray) -> str:
    return sig.astype(">u4").tobytes().hex()


def read_back(fingerprint: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint), ">u4")


def jaccard(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Jaccard similarity of sorted sets; 0 without a comparison where lengths alone keep it under ``least``."""
    if not len(a) or not len(b):
        return 1.0 if len(a) == len(b) else 0.0
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return 0.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def fingerprints(docs: DataFrame, chain: int = CHAIN) -> DataFrame:
    """doc_id, fingerprint and n_signatures of each text. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sigs = [signatures(t, chain) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([written(s) for s in sigs]), pa.array([len(s) for s in sigs], pa.int64())], names=["doc_id", "fingerprint", "n_signatures"])

    return texts(docs).mapInArrow(tidy(run, forget), fields(("doc_id", "long"), ("fingerprint", "string"), ("n_signatures", "long")))


def near_pairs(prints: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Pairs (a < b) of different fingerprints with Jaccard >= threshold, a and b the least doc_id of each,
    and their similarity. Equal fingerprints are one class first, so copies make no pairs.

    Lengths fall in bands whose bounds grow by 1 / threshold: a set meets its own band and the next. In a
    band, a set is listed under its n - ceil(threshold n) + 1 rarest signatures, one of which any partner shares."""
    classes = prints.filter("n_signatures > 0").groupBy("fingerprint").agg(F.min("doc_id").alias("rep"), F.min("n_signatures").alias("n"))
    band = F.floor(F.log("n") / F.lit(-float(np.log(threshold)))).cast("int")
    sig = classes.select("rep", "n", band.alias("band"), F.explode(F.expr("transform(sequence(0, int(n) - 1), i -> substr(fingerprint, 8 * i + 1, 8))")).alias("sig"))
    seen = sig.groupBy("sig").agg(F.count("*").alias("df"))
    order = Window.partitionBy("rep").orderBy("df", "sig")
    listed = sig.join(seen, "sig").withColumn("k", F.row_number().over(order)).filter(F.col("k") <= F.col("n") - F.ceil(F.lit(threshold) * F.col("n")) + 1).filter("df > 1")
    left = listed.select(F.col("rep").alias("a"), F.col("n").alias("na"), "sig", F.explode(F.array("band", F.col("band") + 1)).alias("band"), F.col("band").alias("band_a"))
    right = listed.select(F.col("rep").alias("b"), F.col("n").alias("nb"), "sig", "band")
    alike = (F.least("na", "nb") >= threshold * F.greatest("na", "nb")) & ((F.col("band_a") < F.col("band")) | (F.col("a") < F.col("b")))
    pairs = left.join(right, ["sig", "band"]).filter(alike).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    @F.pandas_udf("double")
    def similarity(x, y):
        return x.combine(y, lambda p, q: jaccard(read_back(p), read_back(q), threshold))

    text = classes.select("rep", "fingerprint")
    both = pairs.join(text.toDF("a", "fa"), "a").join(text.toDF("b", "fb"), "b")
    return both.select("a", "b", similarity("fa", "fb").alias("similarity")).filter(F.col("similarity") >= threshold)


def neighbours(docs: DataFrame) -> DataFrame:
    """Each row with its bucket of doc_ids, and once more, ``edge``, where the bucket before needs it: the
    first row in descending order of a bucket follows the last of the bucket above, and the first of all
    follows the last of all. Bucket bounds are quantiles of doc_id (a number for each BUCKET_DOCS rows); the
    first rows, one for each bucket, are the only other thing that is gathered."""
    base = texts(docs)
    known = base.filter("doc_id IS NOT NULL")
    count = known.count()
    n = min(BUCKETS, max(1, count // BUCKET_DOCS))
    bounds = sorted(set(known.approxQuantile("doc_id", [k / n for k in range(1, n)], min(0.001, 0.2 / n)))) if n > 1 else []
    cuts = docs.sparkSession.sparkContext.broadcast(np.array(bounds))

    @F.pandas_udf("int")
    def bucket(ids):
        return ids.map(lambda v: 0) if not len(cuts.value) else ids.__class__(np.searchsorted(cuts.value, ids.to_numpy(float), side="right"), dtype="int32")

    # Null ids come last in descending order: below every bucket.
    placed = base.withColumn("bucket", F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(bucket(F.coalesce("doc_id", F.lit(0)))))
    heads = placed.groupBy("bucket").agg(F.max(F.col("doc_id")).alias("head")).collect()
    up = sorted((r["bucket"] for r in heads))
    above = {b: up[k + 1] if k + 1 < len(up) else up[0] for k, b in enumerate(up)}
    table = docs.sparkSession.createDataFrame([(r["bucket"], r["head"], above[r["bucket"]]) for r in heads] or [(0, 0, 0)], "bucket int, head long, above int")
    joined = placed.join(F.broadcast(table), "bucket")
    first = F.col("doc_id").eqNullSafe(F.col("head"))
    to = F.when(first, F.array(F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("edge")), F.struct(F.col("above").alias("bucket"), F.lit(True).alias("edge")))).otherwise(
        F.array(F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("edge")))
    )
    return joined.select("doc_id", "text", F.explode(to).alias("to")).select("doc_id", "text", "to.bucket", "to.edge")


def edits(docs: DataFrame, chain: int = CHAIN) -> DataFrame:
    """Each text's fingerprint, that of its edited text, and how like they and the next text's are.

    Rows are dealt by bucket and sorted, so the next row is the next document; texts move once."""
    spread = neighbours(docs)
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    ordered = spread.repartition(n, "bucket").sortWithinPartitions(F.col("bucket"), F.col("edge"), F.col("doc_id").desc_nulls_last(), "text")
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def row(own, text, sig, next_text, next_sig):
        half = len(text) // 2
        edited = text[: len(text) - half] + next_text[:half]
        edited_sig = signatures(edited, chain)
        return (own, len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), written(sig), written(edited_sig), jaccard(sig, edited_sig), jaccard(sig, next_sig))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row of the bucket so far: bucket, doc_id, text, signatures
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch, out = whole.slice(at, 500), []
                for own, text, bucket, edge in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "bucket", "edge")), strict=True):
                    if edge and (held is None or held[0] != bucket):
                        continue  # a second copy of a repeated first row
                    sig = signatures(text, chain)
                    if held is not None and held[0] == bucket:
                        out.append(row(*held[1:], text, sig))
                    held = None if edge else (bucket, own, text, sig)
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return ordered.mapInArrow(tidy(run, forget), fields(*zip(names, ("long", "long", "string", "string", "string", "double", "double"), strict=True)))


def op8_spotsigs(spark, sf_dir: str) -> DataFrame:
    return edits(spark.read.parquet(f"{sf_dir}/documents.parquet"))
