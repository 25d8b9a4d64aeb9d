"""The audit of filters: the transducer against plain Python on random texts, orders against applying them one by one."""

import random
import re
from collections import Counter
from itertools import permutations

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stridewell.llm import filter_audit as audit
from stridewell.llm import queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_counts(text: str) -> tuple[int, ...]:
    words = WORD.findall(text)
    return len(words), len(set(words)), len(re.findall("[A-Z]", text)), len(text), sum(c in audit.SYMBOLS for c in text)


def random_texts(n: int) -> list[str]:
    rng = random.Random(3)
    letters = "aabAZ#|é漢\U0001f600  \x1c\x00 \t\n\x0b\r"
    made = ["".join(rng.choices(letters, k=rng.randrange(60))) for _ in range(n)]
    long = "x" * 70 + "y"
    return made + ["", " ", "a", " a", "a ", long + " " + "x" * 71 + " " + long, " ".join(f"w{k % 700}" for k in range(5000)), "Q" * 3_000_000]


def test_transducer_equals_plain_scan():
    texts = random_texts(3000)
    raw = [t.encode() for t in texts]
    offsets = np.cumsum([0] + [len(r) for r in raw])
    got = audit.transduce(np.frombuffer(b"".join(raw) + bytes(8), np.uint8), offsets)
    assert list(zip(*(got[c].tolist() for c in audit.COUNTED), strict=True)) == [plain_counts(t) for t in texts]


def test_words_with_equal_hashes_stay_apart(monkeypatch):
    monkeypatch.setattr(audit, "_hashes", lambda data, begin, length: np.zeros(len(begin), np.uint64))
    texts = ["a b a c ab ba ab", "a b", "abcdefghi abcdefghj abcdefghi", ""]
    raw = [t.encode() for t in texts]
    got = audit.transduce(np.frombuffer(b"".join(raw) + bytes(8), np.uint8), np.cumsum([0] + [len(r) for r in raw]))
    assert got["n_distinct"].tolist() == [5, 2, 2, 0]


def rows(spark):
    texts = random_texts(60)[:-1] + [" ".join(f"w{k}" for k in range(300)), " ".join(["w"] * 400), " ".join(["W"] * 300), "a# " * 250]
    texts = texts * 2 + [None, None]
    made = [(k if k % 17 else k // 2, t, ("en", "de", None)[k % 3]) for k, t in enumerate(texts)] + [(None, texts[-3], "en"), (None, "own", None)]
    docs = spark.createDataFrame(made, "doc_id long, text string, lang string").withColumns({"part": F.lit("x"), "mask": F.lit(1), "digest": F.lit(2), "n": F.lit(3), "good": F.lit(9)})
    labels = spark.createDataFrame([(k, k % 2, None if k % 5 == 0 else k % 3) for k in range(0, 100, 2)] + [(4, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    return docs, labels, made


def by_hand(made, labels) -> dict:
    """Every order applied filter by filter to the documents themselves."""
    good = {r.doc_id for r in labels if r.quality == 1 and r.doc_id is not None}
    toxic = {r.doc_id for r in labels if r.toxic == 1 and r.doc_id is not None}
    least: dict = {}
    for i, t, _ in made:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    failed = []
    for i, t, lang in made:
        words, distinct, capitals, points, symbols = plain_counts(t or "")
        own = (words < 200, 100 * distinct < 50 * words, 100 * capitals > 3 * points, symbols > 0, i is not None and i > least[t or ""])
        failed.append((lang or "", {c for c, f in zip("ABCDE", own, strict=True) if f}, i in good, i in toxic))
    out, shapley = {}, Counter()
    for part in {p for p, *_ in failed}:
        for order in map("".join, permutations("ABCDE")):
            left = [d for d in failed if d[0] == part]
            gone: list = []
            for step, c in enumerate(order, 1):
                removed = [d for d in left if c in d[1]]
                redundant = sum(c in d[1] for d in gone)
                left, gone = [d for d in left if c not in d[1]], gone + removed
                alone = sum(d[1] == {c} for d in failed if d[0] == part)
                out[part, order, step] = [len(left), len(removed), redundant, alone, sum(d[2] for d in removed), sum(d[3] for d in removed)]
                shapley[part, c] += len(removed)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_every_order_equals_filters_applied_one_by_one(spark):
    docs, labels, made = rows(spark)
    got = audit.interactions(audit.patterns(docs, labels)).collect()
    assert {tuple(r[:3]): tuple(r[3:]) for r in got} == by_hand(made, labels.collect()) and len(got) == 3 * 600


def test_empty_tables(spark):
    docs, labels, _ = rows(spark)
    assert audit.interactions(audit.patterns(docs.limit(0), labels)).count() == 0
    got = audit.interactions(audit.patterns(docs, labels.limit(0)))
    assert got.agg(F.sum("good_lost") + F.sum("toxic_lost")).first()[0] == 0 and got.count() == 1800


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query_equals_sql(spark, folder):
    with duckdb.connect() as duck:
        for table in ("documents", "labels"):
            duck.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')")
        want = duck.execute(queries.FILTER_AUDIT_SQL).df()
    got = audit.op11_filter_audit(spark, folder).toPandas()
    order = lambda d: d[sorted(d.columns)].sort_values(["part", "filter_order", "step"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(order(got), order(want), check_dtype=False)
