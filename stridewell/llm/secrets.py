r"""Secret scan: fixed patterns, then a token-efficiency test.

Ordinary text needs few tokens; a random string needs nearly one for each one or two characters. Of a run of
characters of ``[A-Za-z0-9+/_=-]`` the stretches between words are tested: a run is cut at its signs into parts, parts
that are words under the vocabulary, known digests (hexadecimal, of a digest's length) and UUIDs end a stretch, and a
stretch goes from its first to its last part that is dense by itself. A stretch of at least MIN_RUN characters with
fewer than MAX_EFFICIENCY characters a token is reported as kind ``random``, unless it is a number or an identifier
(words of one case style joined by signs, each of which passes the token-efficiency test itself), or touches a span
that the patterns found. So a key inside a path or an address is found, and nothing of what stands around it.

Defined results: null and empty texts have no spans; spans are in code points, end exclusive; whole texts
are scanned however long; repeated rows are scanned one by one.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fields, texts, workers_import_this

#: The three base patterns and the least length of what they match.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_MIN, ACCESS_MIN = 12, 18
KINDS = ("assign", "access", "hex", "random")

RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
MIN_RUN = 16
MAX_EFFICIENCY = 1.9
#: Hexadecimal lengths of MD5, SHA-1, SHA-224, SHA-256, SHA-384 and SHA-512.
DIGEST_LENGTHS = frozenset((32, 40, 56, 64, 96, 128))
UUID = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
HEXADECIMAL = re.compile(r"[0-9a-fA-F]+")
NUMBER = re.compile(r"[0-9+=/_-]+")
IDENTIFIER = re.compile(r"[+/_=-]*(?:[A-Z]?[a-z]+|[A-Z]+)(?:[+/_=-]+(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]{1,4}))*[+/_=-]*")
LETTERS = re.compile(r"[A-Za-z]+")
PART = re.compile(r"[A-Za-z0-9]+")
#: Letters from which on a part that needs few tokens is a word.
WORD = 4

_encoders: dict = {}


def encoder(path: str):
    """The tiktoken encoding of a rank file, one for each Python worker."""
    if path not in _encoders:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _encoders[path] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of what the patterns find, in order."""
    found = []
    low = text.lower()
    if "passw" in low or "secret" in low or "token" in low or "key" in low:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_MIN]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_MIN]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def known(run: str) -> bool:
    """Digests, UUIDs and numbers, which are random or long but no secrets."""
    return bool((HEXADECIMAL.fullmatch(run) and len(run) in DIGEST_LENGTHS) or UUID.fullmatch(run) or NUMBER.fullmatch(run))


def efficient(run: str, enc, max_efficiency: float = MAX_EFFICIENCY) -> bool:
    return len(run) >= max_efficiency * len(enc.encode_ordinary(run))


def identifier(run: str, enc, max_efficiency: float = MAX_EFFICIENCY) -> bool:
    """Words of one case style joined by signs: a random run of one letter case has the shape of a word, so
    each part must be one under the vocabulary too."""
    return bool(IDENTIFIER.fullmatch(run)) and all(efficient(part, enc, max_efficiency) for part in LETTERS.findall(run))


def stretches(run: str, enc, max_efficiency: float = MAX_EFFICIENCY) -> list[tuple[int, int]]:
    """Where in a run something other than words and known numbers stands, from dense part to dense part."""
    marks = [(m.start(), m.end()) for m in UUID.finditer(run)]
    found, first, last, at = [], None, None, 0
    for m in PART.finditer(run):
        a, b = m.span()
        while at < len(marks) and marks[at][1] <= a:
            at += 1
        part = m[0]
        fixed = at < len(marks) and marks[at][0] <= a or HEXADECIMAL.fullmatch(part) and len(part) in DIGEST_LENGTHS
        word = not fixed and part.isalpha() and len(part) >= WORD and efficient(part, enc, max_efficiency)
        if fixed or word:
            if first is not None:
                found.append((first, last))
            first = None
        elif not part.isdigit() and not efficient(part, enc, max_efficiency):
            first = a if first is None else first
            last = b
    return found if first is None else [*found, (first, last)]


def random_spans(text: str, taken: list[tuple[int, int, int]], enc, max_efficiency: float = MAX_EFFICIENCY) -> list[tuple[int, int, int]]:
    found, at, reach = [], 0, 0
    for m in RUN.finditer(text):
        a, b = m.span()
        # Both lists are in order: ``reach`` is the farthest end of a taken span that starts before this run's end.
        while at < len(taken) and taken[at][0] < b:
            reach = max(reach, taken[at][2])
            at += 1
        if reach > a or known(m[0]):
            continue
        for c, d in stretches(m[0], enc, max_efficiency):
            own = m[0][c:d]
            d += len(m[0]) - d if not m[0][d:].strip("=") else 0  # padding belongs to what it pads
            if d - c >= MIN_RUN and not known(own) and not efficient(own, enc, max_efficiency) and not identifier(own, enc, max_efficiency):
                found.append((a + c, 3, a + d))
    return found


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame, tokenizer: str | None = None, max_efficiency: float = MAX_EFFICIENCY) -> DataFrame:
    """doc_id and the spans of each text, array<struct<start,kind,end>>, by start and kind. No shuffle."""
    path = tokenizer or vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                base = base_spans(text)
                rows.append([{"start": a, "kind": KINDS[k], "end": b} for a, k, b in sorted(base + random_spans(text, base, enc, max_efficiency))])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.string()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, kind)], names=["doc_id", "spans"])

    return texts(docs).mapInArrow(run, fields(("doc_id", "long"), ("spans", "array<struct<start:long,kind:string,end:long>>")))


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def redacted(text: str, enc, max_efficiency: float = MAX_EFFICIENCY) -> str:
    """The text with each secret replaced by its kind in brackets; spans that overlap become one."""
    base = base_spans(text)
    out, at = [], 0
    for a, k, b in sorted(base + random_spans(text, base, enc, max_efficiency)):
        if a >= at:
            out += [text[at:a], f"[{KINDS[k]}]"]
        at = max(at, b)
    return "".join([*out, text[at:]]) if out else text


def redact(docs: DataFrame, tokenizer: str | None = None, max_efficiency: float = MAX_EFFICIENCY) -> DataFrame:
    """The documents, same columns and order of columns, with secrets replaced in ``text``. Where there is an
    ``n_chars``, it follows the new text. Null texts stay null. A task holds one Arrow batch and the strings of
    256 texts."""
    path = tokenizer or vocabulary()
    workers_import_this(docs.sparkSession)
    out = docs.withColumn("text", F.col("text").cast("string"))
    at_text, at_chars = out.columns.index("text"), out.columns.index("n_chars") if "n_chars" in out.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                clean = [None if t is None else redacted(t, enc, max_efficiency) for t in batch.column(at_text).to_pylist()]
                columns = list(batch.columns)
                columns[at_text] = pa.array(clean, columns[at_text].type)
                if at_chars is not None:
                    columns[at_chars] = pa.array([None if t is None else len(t) for t in clean], pa.int64()).cast(columns[at_chars].type)
                yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return out.mapInArrow(run, out.schema)


def digests(spans: DataFrame) -> DataFrame:
    """The contract's columns, from the operator's spans."""
    span = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
    base = F.filter("spans", lambda s: s["kind"] != "random")
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return spans.select(
        "doc_id",
        count("assign"),
        count("access"),
        count("hex"),
        F.sha2(F.array_join(F.transform(base, span), ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", span), ",").alias("spans"),
        count("random"),
    )


def op1_secrets(spark, sf_dir: str) -> DataFrame:
    return digests(scan(spark.read.parquet(f"{sf_dir}/documents.parquet")))


def sha256_hex(value: str) -> str:
    return hashlib.sha256(value.encode()).hexdigest()
