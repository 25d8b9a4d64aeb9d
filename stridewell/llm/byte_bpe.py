"""Byte-level BPE in Spark's higher-order functions.

1. ``segments``: an Arrow pass reads the texts of a task once. It numbers the distinct words (matches of the
   pattern) and writes each text as the numbers of its words, compressed; the words go to buckets by hash.
2. ``distinct``: a word that several segments have meets itself in its bucket, so it is encoded once.
3. The distinct words are encoded by higher-order functions: a word is the array of its bytes' ids, and a fold
   merges the neighbours of lowest rank, looked up in a literal rank map, until none is left.
   A second fold decodes the ids by concatenating literal binary pieces.
4. ``gathered`` packs ids and bytes by segment, and ``joined`` puts each text together from its words.

Words move as packed rows, a few bytes for each word of a segment, and the numbered texts twice; texts do not.
A segment ends after REMEMBERED words or SEGMENT_CHARS characters, so what a task holds is bounded.

The rank map is a flat array without clashes, as a lookup in one large map literal would scan it, and each task reads all
literals anew, in which nested arrays are slow. Words of at most LONGEST bytes are folded over one array of numbers that hold
rank, place and id together. Words of more than LONGEST bytes are first cut where two neighbouring bytes are part of no piece of the vocabulary: no merge can
cross there. A pair that occurs MANY times in a word is merged at all its places in one step, unless that makes a
pair of a lower rank, which has to go first. Both keep the result and save time on very long words.

Defined results: a null text is an empty one and has no ids; repeated rows are encoded one by one; bytes of
decoded ids equal the text's UTF-8 bytes.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fields, release_memory, texts
from .secrets import vocabulary

#: Distinct words and characters that a segment has at most, and characters of a row of numbered texts.
REMEMBERED = 300_000
SEGMENT_CHARS = 64_000_000
BLOCK_CHARS = 2_000_000
#: Uses of words that are packed together.
USES = 400_000
#: Chunks between spaces that are a word, of letters that any Unicode version has as such, or one with a mark.
LETTERS = "^[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]{1,30}$"
MARKED = LETTERS[:-1] + "[.,;:!?]$"
#: Bytes of a word up to which it is not looked at for places to cut.
LONGEST = 64
#: Places of one pair from which on they are merged in one step.
MANY = 64
#: Bits of an id or rank, and what stands for the rank of ids that do not join.
BITS = 20
NONE = (1 << BITS) - 1

WORDS, TEXTS = 0, 1
ROW = (("kind", "int"), ("key", "long"), ("segment", "long"), ("doc_ids", "array<long>"), ("a", "binary"), ("b", "binary"), ("c", "binary"), ("d", "binary"))


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def _prime(least: int) -> int:
    return next(n for n in range(max(2, least), 2 * least + 3) if all(n % k for k in range(2, int(n**0.5) + 1)))


def dealt(keys: list[int]) -> tuple[list[int], list[int | None]]:
    """Steps and places of a table without clashes: a key stands at (key + steps[key % len(steps)]) % len(places). Keys of one
    remainder are moved together to where all their places are free, those that are many first."""
    groups = _prime(len(keys) // 3 + 1)
    size = 2 * len(keys)
    while True:
        size = _prime(size + 1)
        sharing: dict[int, list[int]] = {}
        for key in keys:
            sharing.setdefault(key % groups, []).append(key)
        steps, places = [0] * groups, [None] * size
        for group, own in sorted(sharing.items(), key=lambda x: -len(x[1])):
            at = [key % size for key in own]
            step = next((d for d in range(size) if all(places[(k + d) % size] is None for k in at)), None) if len({*at}) == len(at) else None
            if step is None:
                break
            steps[group] = step
            for key, k in zip(own, at, strict=True):
                places[(k + step) % size] = key
        else:
            return steps, places


def rank_map(ranks: dict[bytes, int]) -> tuple[Column, Column, int, int]:
    """The rank map as two flat literals, array<bigint>, and their lengths (see ``dealt``).

    A pair of pieces (ids a, b) that join to a piece of the vocabulary has the key a * 2**20 + b, and stands in the second as
    key * 2**20 + rank. Every way to cut a piece into two pieces is a pair."""
    if max(ranks.values()) >= NONE:
        raise ValueError(f"ranks must be under {NONE}")
    pairs = {}
    for piece, rank in ranks.items():
        for cut in range(1, len(piece)):
            a, b = ranks.get(piece[:cut]), ranks.get(piece[cut:])
            if a is not None and b is not None:
                pairs[(a << BITS) + b] = rank
    steps, places = dealt(list(pairs))
    table = [None if key is None else (key << BITS) + pairs[key] for key in places]
    literal = lambda x: F.from_json(F.lit(json.dumps(x, separators=(",", ":"))), "array<bigint>")
    return literal(steps), literal(table), len(steps), len(table)


def first_ranks(ranks: dict[bytes, int]) -> tuple[Column, int]:
    """The part of the rank map that a word starts with, as a literal array<bigint>: the rank of the single bytes
    with ids a and b, or NONE, stands at a * wide + b, where ``wide`` is the second result."""
    wide = max(ranks[bytes([x])] for x in range(256)) + 1
    table = [NONE] * wide**2
    for a in range(256):
        for b in range(256):
            table[ranks[bytes([a])] * wide + ranks[bytes([b])]] = ranks.get(bytes([a, b]), NONE)
    return F.from_json(F.lit(json.dumps(table, separators=(",", ":"))), "array<bigint>"), wide


def pieces(ranks: dict[bytes, int]) -> Column:
    """array<binary>: the bytes of each id, a literal."""
    by_id = [""] * (max(ranks.values()) + 1)
    for piece, rank in ranks.items():
        by_id[rank] = base64.b64encode(piece).decode()
    return F.from_json(F.lit(json.dumps(by_id)), "array<binary>")


def _let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it in ``body``: a fold over nothing that starts with it and ends with ``body``."""
    return F.aggregate(F.array().cast("array<int>"), value, lambda held, _: held, body)


#: Looks up the rank that two ids join to, NONE without one.
Ranks = Callable[[Column, Column], Column]


def looked_up(steps: Column, table: Column, groups: int, places: int) -> Ranks:
    def rank(a: Column, b: Column) -> Column:
        entry = lambda key: F.get(table, ((key + F.get(steps, (key % groups).cast("int"))) % places).cast("int"))
        # What stands there is of this key where only the bits of a rank differ; an empty place is null, which least leaves out.
        return _let(F.shiftleft(a, BITS).bitwiseOR(b), lambda key: F.least(entry(key).bitwiseXOR(F.shiftleft(key, BITS)), F.lit(NONE).cast("bigint")))

    return rank


def encode_short(word: Column, rank: Ranks, first: Column, wide: int) -> Column:
    """``encode_word`` of at most 256 bytes. The state of the fold is an array of numbers, for each id: the rank it joins to the
    next at (or NONE), its first byte's place in the word, and the id, so the least number is the first pair of the lowest rank."""
    own, below = lambda x: x.bitwiseAND((1 << 24) - 1), (1 << 32) - 1
    none = F.lit(NONE << 32).cast("bigint")
    ranked = lambda r, x: F.shiftleft(r, 32).bitwiseOR(x)

    def joined(s: Column, i: Column) -> Column:
        """Place i (from one) joined to the next; the rank of the place before it is looked up anew, too."""

        def at(m: Column) -> Column:
            new = F.shiftright(m, 32)
            here = ranked(rank(new, own(F.get(s, i + 1))), m.bitwiseAND(below - (1 << 24) + 1).bitwiseOR(new))
            before = lambda x: ranked(rank(own(x), new), x.bitwiseAND(below))
            changed = F.when(i > 1, F.array(_let(F.get(s, i - 2), before), here)).otherwise(F.array(here))
            return F.concat(F.slice(s, 1, F.greatest(i - 2, F.lit(0))), changed, F.slice(s, i + 2, F.size(s)))

        return _let(F.get(s, i - 1), at)

    def step(s: Column, _: Column) -> Column:
        return _let(F.array_min(s), lambda m: F.when(m >= none, s).otherwise(_let(F.array_position(s, m).cast("int"), lambda i: joined(s, i))))

    start = F.transform(word, lambda x, i: ranked(F.coalesce(F.get(first, (x * wide + F.get(word, i + 1)).cast("int")), F.lit(NONE)), F.shiftleft(i.cast("bigint"), 24).bitwiseOR(x)))
    return F.transform(F.aggregate(F.slice(word, 2, F.size(word)), start, step), own)


def encode_word(word: Column, rank: Ranks, first: Column, wide: int) -> Column:
    """array<bigint> of the ids of a word given as the ids of its bytes. The state of the fold is the ids t and the
    rank r of each id joined to the next; a step joins the first pair of the lowest rank, whose rank is the
    new id, and looks up its two new neighbours only. Without a pair to join, r is empty."""
    pair_rank = lambda a, b: F.nullif(rank(a, b), F.lit(NONE).cast("bigint"))
    nothing = F.array().cast("array<bigint>")

    def ranks(t: Column) -> Column:
        return F.transform(F.slice(t, 1, F.size(t) - 1), lambda x, i: pair_rank(x, F.get(t, i + 1)))

    def first_place(t: Column, r: Column, m: Column) -> Column:
        def merged(i: Column) -> Column:
            return F.struct(
                F.concat(F.slice(t, 1, i - 1), F.array(m), F.slice(t, i + 2, F.size(t))).alias("t"),
                F.concat(
                    F.slice(r, 1, F.greatest(i - 2, F.lit(0))),
                    F.when(i > 1, F.array(pair_rank(F.get(t, i - 2), m))).otherwise(nothing),
                    F.when(i < F.size(r), F.array(pair_rank(m, F.get(t, i + 1)))).otherwise(nothing),
                    F.slice(r, i + 2, F.size(r)),
                ).alias("r"),
            )

        return _let(F.array_position(r, m).cast("int"), merged)

    def all_places(t: Column, r: Column, m: Column) -> Column:
        """Merges at all places from left to right, or at the first one if that makes a pair of lower rank."""
        signs = F.array_join(F.transform(r, lambda x: F.when(x.eqNullSafe(m), F.lit("1")).otherwise(F.lit("0"))), "")
        # Places that overlap: the left one counts.
        signs = F.split(F.concat(F.regexp_replace(signs, "11", "10"), F.lit("0")), "")
        is_first = lambda s, i: F.coalesce(F.get(s, i) == "1", F.lit(False))

        def chosen(s: Column) -> Column:
            new = F.filter(F.transform(t, lambda x, i: F.when(is_first(s, i), m).when(is_first(s, i - 1), F.lit(-1)).otherwise(x)), lambda x: x >= 0)
            # A new id stood beside the next place before that was merged.
            between = F.transform(F.filter(F.sequence(F.lit(0), F.size(t) - 1), lambda i: is_first(s, i) & is_first(s, i + 2)), lambda i: pair_rank(m, F.get(t, i + 2)))

            def safe(new: Column) -> Column:
                return _let(ranks(new), lambda r2: F.when(F.coalesce(F.array_min(F.concat(r2, between)) > m, F.lit(True)), F.struct(new.alias("t"), r2.alias("r"))).otherwise(first_place(t, r, m)))

            return F.when(F.size(new) > 1, _let(new, safe)).otherwise(F.struct(new.alias("t"), nothing.alias("r")))

        return _let(signs, chosen)

    def joined(s: Column, m: Column) -> Column:
        t, r = s["t"], s["r"]
        often = (F.size(r) >= MANY) & (F.size(r) - F.size(F.array_remove(r, m)) >= MANY)
        return F.when(m.isNull(), F.struct(t.alias("t"), nothing.alias("r"))).when(often, all_places(t, r, m)).otherwise(first_place(t, r, m))

    def step(s: Column, _: Column) -> Column:
        return F.when(F.size(s["r"]) == 0, s).otherwise(_let(F.array_min(s["r"]), lambda m: joined(s, m)))

    pairs = F.transform(F.slice(word, 1, F.size(word) - 1), lambda x, i: F.nullif(F.get(first, (x * wide + F.get(word, i + 1)).cast("int")), F.lit(NONE).cast("bigint")))
    start = F.struct(word.alias("t"), pairs.alias("r"))
    return F.when(F.size(word) > 1, F.aggregate(F.slice(word, 1, F.size(word) - 1), start, step)["t"]).otherwise(word)


def merged(word: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """The merges of one word, plainly."""
    t = [word[i : i + 1] for i in range(len(word))]
    while len(t) > 1:
        rank, i = min((ranks.get(t[i] + t[i + 1], 1 << 40), i) for i in range(len(t) - 1))
        if rank == 1 << 40:
            break
        t[i : i + 2] = [t[i] + t[i + 1]]
    return t


def encoded(word: Column, ranks: dict[bytes, int]) -> Column:
    """``encode_word``; a word that is a piece of the vocabulary has that one id, also where the merges do not lead
    to it (in the usual vocabularies they always do)."""
    first, wide = first_ranks(ranks)
    steps, table, groups, places = rank_map(ranks)

    def folded(first: Column, steps: Column, table: Column) -> Column:
        rank = looked_up(steps, table, groups, places)
        return F.when(F.size(word) <= LONGEST, encode_short(word, rank, first, wide)).otherwise(encode_word(word, rank, first, wide))

    known = _let(first, lambda first: _let(steps, lambda steps: _let(table, lambda table: folded(first, steps, table))))
    for piece, rank in ranks.items():
        if len(piece) > 1 and len(merged(piece, ranks)) > 1:
            known = F.when(word == F.array(*(F.lit(ranks[piece[i : i + 1]]).cast("bigint") for i in range(len(piece)))), F.array(F.lit(rank).cast("bigint"))).otherwise(known)
    return known


def decode_word(ids: Column, by_id: Column) -> Column:
    """The bytes of ids: their binary pieces, one after the other."""
    return F.aggregate(ids, F.lit(b""), lambda got, i: F.concat(got, F.get(by_id, i.cast("int"))))


def packed(numbers: np.ndarray) -> bytes:
    """Whole numbers under 2**35, seven bits a byte: all first bytes, then the second ones of the numbers that
    have them, and so on, each compressed by itself."""
    frames, left, packer = [], numbers.astype(np.int64), zstandard.ZstdCompressor(level=3)
    while len(left):
        more = left >> 7
        frames.append(packer.compress((left & 127 | np.where(more > 0, 128, 0)).astype(np.uint8).tobytes()))
        left = more[more > 0]
    return b"".join(len(f).to_bytes(4, "little") + f for f in frames)


def unpacked(data: bytes) -> np.ndarray:
    out, at, place, shift, unpacker = np.zeros(0, np.int64), None, 0, 0, zstandard.ZstdDecompressor()
    while place < len(data):
        end = place + 4 + int.from_bytes(data[place : place + 4], "little")
        b = np.frombuffer(unpacker.decompress(data[place + 4 : end]), np.uint8)
        if at is None:
            out, at = (b & 127).astype(np.int64), np.arange(len(b))
        else:
            out[at] |= (b & 127).astype(np.int64) << shift
        at, place, shift = at[b >= 128], end, shift + 7
    return out


class _Segment:
    """Distinct words, numbered as they come and at the end by frequency, and the texts as numbers of words."""

    def __init__(self, pattern: str, neighbours: frozenset[bytes]):
        self.pattern, self.neighbours = regex.compile(pattern), neighbours
        self.start()

    def start(self) -> None:
        self.words: dict[str, int] = {}
        self.blocks: list[tuple] = []
        self.all_chars = 0
        self.empty()

    def empty(self) -> None:
        self.ids, self.texts, self.chars = [], [], 0

    def cut(self, word: str) -> list[str]:
        """Parts of a long word that no merge joins; bytes that are no whole character become surrogates."""
        coded = word.encode()
        at = [0, *(i for i in range(1, len(coded)) if coded[i - 1 : i + 1] not in self.neighbours), len(coded)]
        return [coded[a:b].decode("utf-8", "surrogateescape") for a, b in zip(at[:-1], at[1:], strict=True)]

    def place(self, text: str) -> bytes:
        """Numbers of the words of a piece of text."""
        known, found = self.words, self.pattern.findall(text)
        if len(text) > LONGEST // 4:
            found = [part for w in found for part in ((w,) if len(w.encode()) <= LONGEST else self.cut(w))]
        return struct.pack(f"<{len(found)}I", *[known.setdefault(w, len(known)) for w in found])

    def add(self, doc_id: int | None, text: str) -> None:
        self.ids.append(doc_id)
        self.texts.append(text)
        self.chars += len(text)
        if self.chars >= BLOCK_CHARS:
            self.close_block()

    def close_block(self) -> None:
        """Numbers the words of the texts since the last block. A space before a visible character starts a word,
        so such texts are cut there, and each different chunk is looked at once."""
        if not self.texts:
            return
        plain = [ODD_SPACE.search(t) is None for t in self.texts]
        cut = pc.split_pattern(pa.array([t if p else "" for t, p in zip(self.texts, plain, strict=True)], pa.large_string()), " ")
        starts, values = cut.offsets.to_numpy()[:-1], cut.values
        later = np.ones(len(values), bool)
        later[starts] = False
        coded = values.filter(pa.array(later)).dictionary_encode()
        # What comes before the first space, or the whole of a text that is not cut, has a number of its own.
        size, flat = self.numbered(coded.dictionary, [t.partition(" ")[0] if p else t for t, p in zip(self.texts, plain, strict=True)])
        which = np.empty(len(values), np.int64)
        which[later] = coded.indices.to_numpy()
        which[starts] = len(coded.dictionary) + np.arange(len(starts))
        begin, counts = np.cumsum(size) - size, size[which]
        within = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        places = flat[np.repeat(begin[which], counts) + within].astype(np.uint32)
        self.blocks.append((self.ids, packed(np.add.reduceat(counts, starts)), places))
        self.all_chars += self.chars
        self.empty()

    def numbered(self, chunks: pa.Array, heads: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """How many words each chunk, with a space before it, and then each head has, and their numbers in turn.
        Chunks of letters are words, and a mark after them is one; the pattern is for the others."""
        known, names = self.words, chunks.to_pylist()
        word, marked = (pc.match_substring_regex(chunks, p).to_numpy(zero_copy_only=False) for p in (LETTERS, MARKED))
        own = [known.setdefault(" " + names[i], len(known)) for i in np.flatnonzero(word).tolist()]
        before = [known.setdefault(" " + names[i][:-1], len(known)) for i in np.flatnonzero(marked).tolist()]
        mark = [known.setdefault(names[i][-1], len(known)) for i in np.flatnonzero(marked).tolist()]
        others = np.flatnonzero(~word & ~marked)
        found = [self.place(" " + names[i]) for i in others.tolist()] + list(map(self.place, heads))
        size = np.ones(len(names) + len(heads), np.int64)
        size[np.flatnonzero(marked)] = 2
        rest = np.concatenate((others, len(names) + np.arange(len(heads))))
        size[rest] = np.fromiter(map(len, found), np.int64, len(found)) // 4
        flat, begin = np.empty(size.sum(), np.int64), np.cumsum(size) - size
        flat[begin[: len(names)][word]] = own
        flat[begin[: len(names)][marked]] = before
        flat[begin[: len(names)][marked] + 1] = mark
        place = np.ones(len(flat), bool)
        place[begin[: len(names)][word]] = place[begin[: len(names)][marked]] = place[begin[: len(names)][marked] + 1] = False
        flat[place] = np.frombuffer(b"".join(found), "<u4")
        return size, flat

    def full(self) -> bool:
        return len(self.words) > REMEMBERED or self.all_chars + self.chars > SEGMENT_CHARS

    def batches(self, name: int, buckets: int) -> Iterator[pa.RecordBatch]:
        """Its words by bucket and its texts. The segment's key follows from the task and from the words in
        their order, so rows of a rerun in another order cannot be taken for these."""
        self.close_block()
        # Frequent words get the small numbers, which take less room.
        often = sum((np.bincount(places, minlength=len(self.words)) for _, _, places in self.blocks), np.zeros(len(self.words), np.int64))
        by_number = np.argsort(-often, kind="stable")
        number = np.empty(len(by_number), np.int64)
        number[by_number] = np.arange(len(by_number))
        words = list(self.words)
        words = [words[i].encode("utf-8", "surrogateescape") for i in by_number.tolist()]
        key = xxhash.xxh3_64_intdigest(b"\0".join(words), seed=name) >> 1
        bucket = np.fromiter((xxhash.xxh3_64_intdigest(w) % buckets for w in words), np.int64, len(words))
        order = np.argsort(bucket, kind="stable")
        bounds = np.flatnonzero(np.diff(bucket[order], prepend=-1, append=-1))
        rows = []
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            at = order[a:b]
            own = [words[i] for i in at.tolist()]
            text = zstandard.ZstdCompressor(level=3).compress(b"".join(own))
            rows.append((WORDS, int(bucket[at[0]]), key, None, text, packed(np.array([len(w) for w in own], np.uint32)), packed(np.diff(at, prepend=0).astype(np.uint32)), None))
        rows += [(TEXTS, key, key, ids, counts, packed(number[places]), None, None) for ids, counts, places in self.blocks]
        self.start()
        for k in range(0, len(rows), 16):
            yield batch_of(rows[k : k + 16])


KINDS = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, KINDS[kind]) for c, (_, kind) in zip(zip(*rows, strict=True), ROW, strict=True)], names=[n for n, _ in ROW])


#: A space that white space follows or that ends the text.
ODD_SPACE = regex.compile(r" (?:\s|\Z)")


def segments(docs: DataFrame, ranks: dict[bytes, int], buckets: int) -> DataFrame:
    """Rows of kind WORDS (key: bucket; a, b, c: words, their lengths, steps between their numbers) and of
    kind TEXTS (key: segment; a, b: words of each text, their numbers)."""
    import public_tokenizers

    pattern, neighbours = public_tokenizers.PATTERN, frozenset(w[i : i + 2] for w in ranks for i in range(len(w) - 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        name, segment = context.partitionId() if context else 0, _Segment(pattern, neighbours)
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                segment.add(doc_id, text.as_py())
                if segment.full():
                    yield from segment.batches(name, buckets)
            release_memory()
        yield from segment.batches(name, buckets)
        release_memory()

    return texts(docs).mapInArrow(run, fields(*ROW))


#: A word's place in a segment: the words it stands for.
USE = np.dtype([("segment", "<i8"), ("at", "<u4")])


def distinct(rows: DataFrame, byte_ids: list[int]) -> DataFrame:
    """Each word of a bucket once: ``word``, the ids of its bytes, and ``uses``, its places in segments. Rows of other kinds
    go through. Rows come sorted by kind and bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.array(byte_ids, np.int64)
        bucket, words, places, uses = None, {}, [], []

        def flushed() -> Iterator[pa.RecordBatch]:
            if not words:
                return
            all_places, all_uses = np.concatenate(places), np.concatenate(uses)
            order = np.argsort(all_places, kind="stable")
            held = np.concatenate(([0], np.cumsum(np.bincount(all_places, minlength=len(words))))).astype(np.int32) * USE.itemsize
            used = pa.Array.from_buffers(pa.binary(), len(words), [None, pa.py_buffer(held), pa.py_buffer(all_uses[order].tobytes())])
            ends = np.concatenate(([0], np.cumsum([len(w) for w in words]))).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(table[np.frombuffer(b"".join(words), np.uint8)]))
            n = len(words)
            empty = [pa.nulls(n, KINDS[kind]) for _, kind in ROW]
            empty[0] = pa.array(np.full(n, WORDS, np.int32))
            whole = pa.RecordBatch.from_arrays([*empty, ids, used], names=[*(c for c, _ in ROW), "word", "uses"])
            for k in range(0, n, 5000):
                yield whole.slice(k, 5000)

        for batch in batches:
            for k, (kind, key) in enumerate(zip(batch.column("kind").to_pylist(), batch.column("key").to_pylist(), strict=True)):
                if (kind, key) != bucket:
                    yield from flushed()
                    bucket, words, places, uses = (kind, key), {}, [], []
                if kind == TEXTS:
                    one = batch.slice(k, 1)
                    yield pa.RecordBatch.from_arrays([*one.columns, pa.nulls(1, pa.list_(pa.int64())), pa.nulls(1, pa.binary())], names=[*one.schema.names, "word", "uses"])
                    continue
                ends = np.concatenate(([0], np.cumsum(unpacked(batch.column("b")[k].as_py())))).tolist()
                text, at = zstandard.ZstdDecompressor().decompress(batch.column("a")[k].as_py()), np.cumsum(unpacked(batch.column("c")[k].as_py()))
                places.append(np.array([words.setdefault(text[x:y], len(words)) for x, y in zip(ends[:-1], ends[1:], strict=True)], np.int64))
                own = np.empty(len(at), USE)
                own["segment"], own["at"] = batch.column("segment")[k].as_py(), at
                uses.append(own)
        yield from flushed()

    return rows.mapInArrow(run, fields(*ROW, ("word", "array<long>"), ("uses", "binary")))


def gathered(rows: DataFrame) -> DataFrame:
    """Ids and decoded bytes of words packed by segment, about USES uses of words at a time: key; a: places and
    lengths of the decoded bytes, b: how many ids each has, c: ids, d: decoded."""

    def packed_rows(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        column = lambda c: pa.concat_arrays([b.column(c) for b in batches])
        used, coded, decoded = column("uses"), column("ids"), column("decoded")
        use = np.frombuffer(b"".join(used.to_pylist()), USE)
        row = np.repeat(np.arange(len(used)), pc.binary_length(used).to_numpy() // USE.itemsize)
        order = np.lexsort((use["at"], use["segment"]))
        use, row = use[order], row[order]
        bounds = np.flatnonzero(np.concatenate(([True], use["segment"][1:] != use["segment"][:-1], [True])))
        out = []
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            mine = pa.array(row[a:b])
            ids, plain = coded.take(mine), decoded.take(mine)
            places = packed(np.diff(use["at"][a:b].astype(np.int64), prepend=0))
            sizes = packed(pc.binary_length(plain).to_numpy())
            head = b"".join(len(x).to_bytes(4, "little") + x for x in (places, sizes))
            text = zstandard.ZstdCompressor(level=3).compress(b"".join(plain.to_pylist()))
            out.append((WORDS, int(use["segment"][a]), None, None, head, packed(pc.list_value_length(ids).to_numpy()), packed(ids.flatten().to_numpy()), text))
        return batch_of(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, uses = [], 0
        for batch in batches:
            own = pc.equal(batch.column("kind"), WORDS)
            rest, mine = batch.filter(pc.invert(own)), batch.filter(own)
            if rest.num_rows:
                yield rest.select([n for n, _ in ROW])
            if mine.num_rows:
                held.append(mine.select(["uses", "ids", "decoded"]))
                uses += pc.sum(pc.binary_length(mine.column("uses"))).as_py() // USE.itemsize
            if uses >= USES:
                yield packed_rows(held)
                held, uses = [], 0
                release_memory()
        if held:
            yield packed_rows(held)
        release_memory()

    return rows.mapInArrow(run, fields(*ROW))


def _binary(lengths: np.ndarray, data: bytes) -> pa.Array:
    ends = np.concatenate(([0], np.cumsum(lengths))).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(ends), pa.py_buffer(data)])


class _Table:
    """Ids and bytes of a segment's words by number."""

    def __init__(self):
        self.at, self.ids, self.plain, self.ready = [], [], [], False

    def add(self, head: bytes, lengths: bytes, ids: bytes, decoded: bytes) -> None:
        n = int.from_bytes(head[:4], "little")
        places, sizes = head[4 : 4 + n], head[8 + n :]
        self.at.append(np.cumsum(unpacked(places)))
        self.ids.append(_binary(4 * unpacked(lengths), unpacked(ids).astype("<u4").tobytes()))
        self.plain.append(_binary(unpacked(sizes), zstandard.ZstdDecompressor().decompress(decoded)))

    def finish(self) -> None:
        at = np.concatenate(self.at) if self.at else np.zeros(0, np.int64)
        order = np.argsort(at)
        if len(at) and not np.array_equal(at[order], np.arange(len(at))):
            raise RuntimeError("a segment's words are not whole: its texts were numbered anew in another order")
        take = lambda parts: pa.concat_arrays(parts).take(pa.array(order)) if parts else pa.array([], pa.large_binary())
        self.ids, self.plain, self.ready = take(self.ids), take(self.plain), True

    def text(self, which: pa.Array, places: pa.Array, ends: np.ndarray) -> pa.Array:
        """The words of texts that end before the places ``ends``, put together."""
        if not len(places):
            return pa.array([b""] * (len(ends) - 1), pa.binary())
        words = which.take(places)
        offsets = np.frombuffer(words.buffers()[1], np.int64, len(words) + 1, words.offset * 8)[ends]
        return pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(offsets.copy()), words.buffers()[2]]).cast(pa.binary())


def joined(rows: DataFrame) -> DataFrame:
    """doc_id, ids and decoded of each text. Rows come sorted by key and kind: a segment's words, then its texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, table = None, _Table()
        for batch in batches:
            for k, (kind, key) in enumerate(zip(batch.column("kind").to_pylist(), batch.column("key").to_pylist(), strict=True)):
                if key != held:
                    held, table = key, _Table()
                if kind == WORDS:
                    table.add(*(batch.column(c)[k].as_py() for c in "abcd"))
                    continue
                if not table.ready:
                    table.finish()
                ends = np.concatenate(([0], np.cumsum(unpacked(batch.column("a")[k].as_py())))).astype(np.int64)
                places = pa.array(unpacked(batch.column("b")[k].as_py()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_ids")[k].values, table.text(table.ids, places, ends), table.text(table.plain, places, ends)], names=["doc_id", "ids", "decoded"])

    return rows.mapInArrow(run, fields(("doc_id", "long"), ("ids", "binary"), ("decoded", "binary")))


def encode(docs: DataFrame, tokenizer: str | None = None, buckets: int | None = None) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit) and decoded bytes of each text."""
    ranks = read_ranks(tokenizer or vocabulary())
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    numbered = segments(docs, ranks, buckets or parts).repartition(parts, "key", "kind").sortWithinPartitions("kind", "key")
    once = distinct(numbered, [ranks[bytes([x])] for x in range(256)])
    names = [n for n, _ in ROW]
    coded = once.select(*names, "uses", F.when(F.col("word").isNotNull(), encoded(F.col("word"), ranks)).alias("ids"))
    plain = coded.withColumn("decoded", F.when(F.col("ids").isNotNull(), _let(pieces(ranks), lambda by_id: decode_word(F.col("ids"), by_id))))
    return joined(gathered(plain).repartition(parts, "key").sortWithinPartitions("key", "kind"))


def op7_byte_bpe(spark, sf_dir: str) -> DataFrame:
    coded = encode(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
