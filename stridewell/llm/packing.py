"""Packing of tokenised documents into fixed windows, planned from the histogram of piece lengths.

1. ``tokenise``: each document becomes its ids and a closing id, cut at every WINDOW ids. What is left of a
   document is one last piece, so lengths lie in 1..WINDOW and their histogram has at most WINDOW bars.
2. ``plan``: shallow combinations of two to four lengths that fill a window exactly are enumerated, their
   repeat counts solved against the histogram by non-negative least squares, rounded down and cut to what is
   there; what the rounding leaves is packed greedily, largest first, each time with the largest length that
   still fits. All of this works on counts by length, never on documents.
3. ``assign``: pieces of one length are numbered over the cluster and each number finds its sequence and
   offset in the plan's intervals.

Defined results: a null or empty text is the closing id alone; equal rows are packed one by one; an empty
table gives no pieces; the plan is the same for the same histogram.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fields, staged, texts, tidy

WINDOW = 2048
#: The id that closes a document.
CLOSING = 1
#: Chunks of text whose ids a worker remembers.
REMEMBERED = 400_000
#: Third lengths tried for each pair, and fourth ones for each triple.
BREADTH = (12, 3)
NNLS_STEPS = 300
#: Pieces of a length that are numbered in one task, about.
PIECES_A_TASK = 5_000

_workers: dict = {}


def forget() -> None:
    """Drops what this Python worker has remembered."""
    _workers.clear()


class _Chunks(dict):
    """Packed ids of a chunk of text without spaces. The tokenizer drops white space and never joins
    characters across it, so a text's ids are those of its chunks in order.

    A chunk of ASCII and Latin-1 letters is split into runs as the tokenizer's own pattern does and each
    run goes to its merges at once; any other chunk goes through the whole tokenizer."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.runs: dict[str, bytes] = {}

    def __missing__(self, chunk: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        if chunk.isascii() and chunk.isalpha():
            ids = self.run(chunk.lower())
        elif SIMPLE.fullmatch(chunk):
            ids = b"".join(map(self.run, RUNS.findall(chunk.lower())))
        else:
            ids = np.array(self.tokenizer.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()
        self[chunk] = ids
        return ids

    def run(self, run: str) -> bytes:
        if (ids := self.runs.get(run)) is None:
            if len(self.runs) >= REMEMBERED:
                self.runs.clear()
            written = run if run.isascii() and run.isprintable() else "".join(map(BYTE_CHARS.__getitem__, run.encode()))
            ids = self.runs[run] = struct.pack(f"<{len(found)}I", *found) if (found := [t.id for t in self.tokenizer.model.tokenize(written)]) else b""
        return ids


def _byte_chars() -> list[str]:
    """Printable stand-ins of the 256 bytes in byte-level vocabularies: bytes that print stay, others follow
    from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    chars = {b: chr(b) for b in prints}
    chars |= {b: chr(256 + k) for k, b in enumerate(sorted(set(range(256)) - set(prints)))}
    return [chars[b] for b in range(256)]


BYTE_CHARS = _byte_chars()
#: Chunks that need no normal form and lower as they stand.
SIMPLE = re.compile("[\x21-\x7e\n\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]*")
#: The tokenizer's pattern, for such chunks after lowering.
RUNS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^\\s0-9a-z\u00df-\u00f6\u00f8-\u00ff]+")


def chunk_ids(path: str) -> _Chunks:
    if path not in _workers:
        _workers[path] = _Chunks(path)
    return _workers[path]


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def tokenise(docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW) -> DataFrame:
    """doc_id, doc_tokens and the CRC-32 of each piece's ids, in order. No shuffle."""
    path = tokenizer or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, closing = chunk_ids(path), np.array([CLOSING], "<u4").tobytes()
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                tokens, crcs = [], []
                for text in batch.column("text").to_pylist():
                    ids = b"".join(map(known.__getitem__, text.split(" "))) + closing
                    tokens.append(len(ids) // 4)
                    crcs.append([zlib.crc32(ids[a : a + 4 * window]) for a in range(0, len(ids), 4 * window)])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(tokens, pa.int64()), pa.array(crcs, pa.list_(pa.int64()))], names=["doc_id", "doc_tokens", "crcs"])

    return texts(docs).mapInArrow(tidy(run, forget), fields(("doc_id", "long"), ("doc_tokens", "long"), ("crcs", "array<long>")))


def combinations(hist: np.ndarray, window: int) -> list[tuple[int, ...]]:
    """Combinations of 2 to 4 lengths that have pieces and add up to the window."""
    have = np.flatnonzero(hist)
    have = have[(have > 0) & (have < window)]
    there, found = set(have.tolist()), set()
    order = have[np.argsort(-hist[have], kind="stable")]
    for a in have.tolist():
        if (b := window - a) in there:
            found.add(tuple(sorted((a, b), reverse=True)))
        for b in order[order < window - a][: BREADTH[0]].tolist():
            rest = window - a - b
            if rest in there:
                found.add(tuple(sorted((a, b, rest), reverse=True)))
            for c in order[order < rest][: BREADTH[1]].tolist():
                if rest - c in there:
                    found.add(tuple(sorted((a, b, c, rest - c), reverse=True)))
    return sorted(found, reverse=True)


def solve(combos: list[tuple[int, ...]], hist: np.ndarray, steps: int = NNLS_STEPS) -> np.ndarray:
    """x >= 0 that minimises |A x - hist|^2, where A counts the lengths of each combination: projected
    gradient with Nesterov's momentum, steps scaled by the columns' and rows' sizes."""
    cols = np.repeat(np.arange(len(combos)), [len(c) for c in combos])
    rows = np.concatenate([np.array(c) for c in combos])
    use = np.bincount(rows, minlength=len(hist)).astype(float)
    # |A| is bounded by the largest sum over a column's rows of their use.
    scale = 1.0 / np.bincount(cols, weights=use[rows], minlength=len(combos))
    x = y = np.zeros(len(combos))
    t = 1.0
    for _ in range(steps):
        off = np.bincount(rows, weights=y[cols], minlength=len(hist)) - hist
        new = np.maximum(0.0, y - scale * np.bincount(cols, weights=off[rows], minlength=len(combos)))
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x


def plan(counts: dict[int, int], window: int = WINDOW) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, how many such sequences), using every piece once."""
    hist = np.zeros(window + 1, np.int64)
    for length, n in counts.items():
        hist[length] = n
    out: list[tuple[tuple[int, ...], int]] = []
    if hist[window]:
        out.append(((window,), int(hist[window])))
        hist[window] = 0
    if combos := combinations(hist, window):
        wanted = np.floor(solve(combos, hist.astype(float)) + 1e-6).astype(np.int64)
        for k in np.argsort(-wanted, kind="stable"):
            sizes, times = np.unique(combos[k], return_counts=True)
            n = int(min(wanted[k], (hist[sizes] // times).min()))
            if n > 0:
                hist[sizes] -= n * times
                out.append((combos[k], n))
    while (left := np.flatnonzero(hist)).size:
        room, lengths, take = window, [], hist.copy()
        at = int(left[-1])
        while True:
            lengths.append(at)
            take[at] -= 1
            room -= at
            fits = np.flatnonzero(take[: room + 1])
            if not fits.size or fits[-1] == 0:
                break
            at = int(fits[-1])
        sizes, times = np.unique(lengths, return_counts=True)
        n = int((hist[sizes] // times).min())
        hist[sizes] -= n * times
        out.append((tuple(lengths), n))
    return out


def intervals(planned: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length: first number, first sequence and offset of each run of numbers."""
    used: dict[int, int] = {}
    found: dict[int, list[tuple[int, int, int]]] = {}
    sequence = 0
    for lengths, n in planned:
        offset = 0
        for length in lengths:
            first = used.get(length, 0)
            found.setdefault(length, []).append((first, sequence, offset))
            used[length] = first + n
            offset += length
        sequence += n
    return {k: tuple(np.array(x, np.int64) for x in zip(*v, strict=True)) for k, v in found.items()}


def numbered(pieces: DataFrame, total: int) -> DataFrame:
    """Pieces with ``number``: 0, 1, ... within each length. A length is dealt over salts, so that one that
    holds most pieces takes many tasks; numbers start after the salts before it."""
    salts = max(64, total // PIECES_A_TASK)
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(salts)).cast("int"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    sums = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    starts = sums.select(F.col("length").alias("_length"), F.col("salt").alias("_salt"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    own = Window.partitionBy("length", "salt").orderBy("doc_id", "start")
    ranked = salted.withColumn("place", F.row_number().over(own) - 1)
    joined = ranked.join(starts, (F.col("length") == F.col("_length")) & (F.col("salt") == F.col("_salt")))
    return joined.select(*pieces.columns, (F.col("first") + F.col("place")).alias("number"))


def pack(docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW) -> DataFrame:
    """One row for each piece of each document, with its place in a sequence."""
    tokens = staged(tokenise(docs, tokenizer, window), "pack-tokens")
    pieces = tokens.select("doc_id", "doc_tokens", F.posexplode("crcs").alias("k", "ids_crc32")).select(
        "doc_id",
        (F.col("k").cast("long") * window).alias("start"),
        F.least(F.lit(window).cast("long"), F.col("doc_tokens") - F.col("k").cast("long") * window).alias("length"),
        "ids_crc32",
        "doc_tokens",
    )
    # At most ``window`` rows reach the driver.
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    runs = docs.sparkSession.sparkContext.broadcast(intervals(plan(counts, window)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, number = batch.column("length").to_numpy(), batch.column("number").to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for size in np.unique(length):
                own = np.flatnonzero(length == size)
                first, seq, off = runs.value[int(size)]
                at = np.searchsorted(first, number[own], side="right") - 1
                sequence[own], offset[own] = seq[at] + number[own] - first[at], off[at]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    out = fields(("doc_id", "long"), ("start", "long"), ("length", "long"), ("ids_crc32", "long"), ("doc_tokens", "long"), ("sequence_id", "long"), ("offset", "long"))
    return numbered(pieces, sum(counts.values())).mapInArrow(place, out)


def op3_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
