"""Quality rules with host verdicts, in DataFrame functions only (native).

``document_rules`` measures each whole text; ``host_verdicts`` sums rule failures by host, shrinks each
host's rate with a beta prior whose two parameters are fitted to all hosts (method of moments), and
``apply_rules`` joins the verdicts back to the documents.

Defined results: a null text has no words and fails (n_words < 50); a null host is a host of its own;
repeated rows are measured and counted one by one; an empty table gives an empty result. Only doc_id,
text and the host column are read, so other columns cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, staged

#: The characters counted as symbols.
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A host is refused where its shrunken failure rate, less DEVIATIONS of its standard deviations, is over HOST_RATE and
#: over so many TIMES the rate of all documents: beyond doubt most of its documents fail, and far more than elsewhere.
HOST_RATE = 0.5
DEVIATIONS = 2.0
TIMES = 2.0
#: Prior where the hosts' rates cannot be told apart or there is one host.
FLAT_PRIOR = (1.0, 1.0)


def _let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it in ``body``."""
    return F.transform(F.array(value), body)[0]


def _stretches(places: Column) -> Column:
    """Words in the union of [place, place+3) over sorted places."""
    return _let(
        places,
        lambda b: F.aggregate(
            F.transform(b, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(b, k + 1) - x, F.lit(3)))), F.lit(0).cast("long"), lambda a, x: a + x
        ),
    )


#: Up to this many repeated hashes are looked up one by one; beyond, places are sorted by hash.
FEW = 32


def _covered(windows: Column) -> Column:
    """Words inside a 3-word window whose hash occurs at least twice.

    Sorting the hashes gives those that occur again. Where they are few, a scan finds their places; else
    (hash, place) pairs are sorted and equal neighbours kept, so the cost stays n log n for any text."""
    again = _let(F.sort_array(windows), lambda s: F.array_distinct(F.filter(s, lambda x, k: F.coalesce(F.get(s, k + 1) == x, F.lit(False)))))

    def scanned(found: Column) -> Column:
        return F.filter(F.sequence(F.lit(0), F.size(windows) - 1), lambda i: F.array_contains(found, F.get(windows, i)))

    pairs = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    equal = lambda s, k, x: F.coalesce(F.get(s, k)["h"] == x["h"], F.lit(False))
    by_hash = _let(
        pairs,
        lambda s: F.array_sort(F.transform(F.filter(s, lambda x, k: equal(s, k - 1, x) | equal(s, k + 1, x)), lambda x: x["i"])),
    )
    return _let(again, lambda found: F.when(F.size(found) <= FEW, _stretches(scanned(found))).otherwise(_stretches(by_hash)))


def document_rules(docs: DataFrame, host: str = "source") -> DataFrame:
    """doc_id, host and the base measures of every text; ``base_failed`` is the base rule."""
    text = F.col("text")
    base = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col(host).cast("string").alias("host"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(" \t\n\x0b\x0c\r")) != "")
    kept = text
    for c in SYMBOLS:
        kept = F.replace(kept, F.lit(c), F.lit(""))
    counted = base.select(
        "doc_id",
        "host",
        F.xxhash64(text).alias("text_hash"),
        words.alias("w"),
        lines.alias("lines"),
        (F.length(text) - F.length(kept)).cast("long").alias("n_symbols"),
    )
    windows = F.transform(
        F.slice(F.col("w"), 1, F.greatest(F.size("w") - 2, F.lit(0))),
        lambda x, i: F.xxhash64(x, F.get(F.col("w"), i + 1), F.get(F.col("w"), i + 2)),
    )
    hashed = counted.select(
        "doc_id",
        "host",
        "text_hash",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        windows.alias("windows"),
    )
    repeats = F.when(F.size(F.array_distinct("windows")) == F.size("windows"), F.lit(0).cast("long")).otherwise(_covered(F.col("windows")))
    out = hashed.select("doc_id", "host", "text_hash", "n_words", "word_chars", "n_symbols", "n_dup_lines", repeats.alias("n_repeat_words"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def host_verdicts(measured: DataFrame, host_rate: float = HOST_RATE) -> DataFrame:
    """host, its documents and failures, the shrunken rate, its lower bound and the verdict.

    Rates p_i = f_i / n_i over all hosts with at least two documents give mean m and variance v; the beta
    prior has strength s = m (1 - m) / v - 1 (at least 1), and the rate is r = (f + m s) / (n + s), the mean of
    a beta distribution with the variance r (1 - r) / (n + s + 1)."""
    hosts = measured.groupBy("host").agg(F.count("*").alias("host_docs"), F.sum(F.col("base_failed").cast("long")).alias("host_failed"))
    rate = F.col("host_failed") / F.col("host_docs")
    several = F.col("host_docs") >= 2
    fitted = hosts.agg(
        (F.sum("host_failed") / F.sum("host_docs")).alias("m"),
        F.var_pop(F.when(several, rate)).alias("v"),
    )
    prior = fitted.select(
        F.col("m"),
        F.when((F.col("v") > 0) & (F.col("m") > 0) & (F.col("m") < 1), F.greatest(F.lit(1.0), F.col("m") * (1 - F.col("m")) / F.col("v") - 1)).alias("s"),
    )
    overall = F.coalesce(F.col("m"), F.lit(0.0)).alias("overall")
    alpha = F.coalesce(F.col("m") * F.col("s"), F.lit(FLAT_PRIOR[0]))
    beta = F.coalesce((1 - F.col("m")) * F.col("s"), F.lit(FLAT_PRIOR[1]))
    # The prior is one row: an aggregate without keys.
    known = hosts.join(F.broadcast(prior.select(alpha.alias("a"), beta.alias("b"), overall, F.lit(1).alias("one"))), F.lit(1) == F.col("one"))
    weight, shrunk = F.col("host_docs") + F.col("a") + F.col("b"), F.col("host_rate")
    rated = known.withColumn("host_rate", (F.col("host_failed") + F.col("a")) / weight)
    low = shrunk - F.lit(DEVIATIONS) * F.sqrt(shrunk * (1 - shrunk) / (weight + 1))
    return rated.select("host", "host_docs", "host_failed", "host_rate", low.alias("host_low"), (low > F.greatest(F.lit(host_rate), TIMES * F.col("overall"))).alias("host_refused"))


def apply_rules(docs: DataFrame, host: str = "source", host_rate: float = HOST_RATE) -> DataFrame:
    """Measures and verdict of each document. The measures are written once (short rows, no text): the
    host totals and the join read them from there."""
    measured = staged(document_rules(docs, host), "host-rules")
    verdicts = host_verdicts(measured, host_rate)
    joined = measured.join(verdicts, measured["host"].eqNullSafe(verdicts["host"]), "left").drop(verdicts["host"])
    return joined.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(F.col("host_refused"), F.lit(False)))


def keep_documents(docs: DataFrame, host: str = "source", host_rate: float = HOST_RATE) -> DataFrame:
    """The documents, all their columns, that base rule and host verdict keep. Verdicts are short rows by
    doc_id, hash of the text and host; the documents meet them once."""
    id_, hash_, host_ = (free_name(docs, x) for x in ("kept_id", "kept_hash", "kept_host"))
    kept = apply_rules(docs, host, host_rate).filter("kept").select(F.col("doc_id").alias(id_), F.col("text_hash").alias(hash_), F.col("host").alias(host_)).distinct()
    own_hash = F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")))
    same = docs["doc_id"].cast("long").eqNullSafe(F.col(id_)) & (own_hash == F.col(hash_)) & docs[host].cast("string").eqNullSafe(F.col(host_))
    return docs.join(kept, same, "left_semi")


def op10_host_rules(spark, sf_dir: str) -> DataFrame:
    out = apply_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
