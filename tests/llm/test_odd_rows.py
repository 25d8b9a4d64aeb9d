"""Odd rows, ties and brute force of single steps: nulls, repeated rows, clashing columns, very long texts."""

import numpy as np
from pyspark.sql import functions as F

from stridewell.llm import host_rules, html_main, mil_quality, packing, secrets, spotsigs, toxicity, warc


def test_attention_gradients_by_finite_differences():
    rng = np.random.default_rng(1)
    sizes = np.array([1, 3, 2])
    starts, bag = np.concatenate(([0], np.cumsum(sizes)[:-1])), np.repeat(np.arange(3), sizes)
    h, y, weight = rng.normal(size=(6, 5)), np.array([1.0, 0.0, 1.0]), np.array([1.0, 2.0, 0.5])
    p = {"V": rng.normal(size=(5, 4)), "U": rng.normal(size=(5, 4)), "w": rng.normal(size=4), "c": rng.normal(size=5), "b": rng.normal(size=1)}

    def loss():
        s = mil_quality.forward(p, h, bag, starts)[0]
        return float((-(y * np.log(s) + (1 - y) * np.log(1 - s)) * weight).sum() / weight.sum())

    for name, g in mil_quality.gradients(p, h, bag, starts, y, weight).items():
        for at in np.ndindex(p[name].shape):
            held = p[name][at]
            p[name][at] = held + 1e-6
            up = loss()
            p[name][at] = held - 1e-6
            down = loss()
            p[name][at] = held
            assert abs((up - down) / 2e-6 - g[at]) < 1e-6


def test_best_run_against_all_runs():
    rng = np.random.default_rng(2)
    for _ in range(300):
        scored = [(float(w), None) for w in rng.integers(-3, 4, rng.integers(0, 12))]
        sums = [(sum(w for w, _ in scored[a:b]), -a, a, b) for a in range(len(scored)) for b in range(a + 1, len(scored) + 1)]
        a, b = html_main.best_run(scored)
        best = max((s for s, *_ in sums), default=0.0)
        assert sum(w for w, _ in scored[a:b]) == max(best, 0.0)


def test_pages_with_odd_rows(spark):
    long = "<article>" + "".join(f"<p>word{k} and more</p>" for k in range(30_000)) + "</article><footer>end</footer>"
    rows = [(1, "u", long), (None, "u", "<article><p>one two</p></article>"), (None, None, None), (2, "u", "<p>a b</p>"), (2, "u", "<p>a b</p>"), (3, "u", "<nav>x</nav>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash")).withColumn("own", F.lit(1)).withColumn("rank", F.lit(2))
    got = html_main.extract(pages).collect()
    assert len(got) == len(rows) and sorted(str(r.page_id) for r in got) == sorted(str(r[0]) for r in rows)
    text = {r.page_id: r.text for r in got if r.page_id in (1, 2)}
    assert text[1].count("\n\n") == 29_999 and text[1].endswith("word29999 and more") and text[2] == "a b"
    assert html_main.learn_weights(pages)["p"] == html_main.learn_weights(pages.unionByName(pages))["p"]


def test_archive_with_odd_rows(spark, tmp_path):
    rows = [(None, None, "x" * 3_000_000), (None, "u", None), (4, "u", "x" * 3_000_000), (4, "u", "x" * 3_000_000), (9, "u", "y")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"payload": F.lit(1), "sha1": F.lit("z"), "response_id": F.lit(3)})
    warc.write(warc.page_records(pages), str(tmp_path))
    got = sorted((r.record_type, r.full_payload_bytes) for r in warc.read(spark, str(tmp_path)).collect())
    assert got == sorted([("revisit", 3_000_000), ("response", 0), ("response", 3_000_000), ("response", 3_000_000), ("response", 1)])


def documents(spark):
    rows = [(1, "same text of seven words right here", "a"), (1, "same text of seven words right here", "a"), (1, "another text", None), (None, "no id", None), (None, None, "b"), (2, "", "b"), (3, "é" * 5_000 + " " + "x" * 200_000, "a")]
    clash = {c: F.lit(1) for c in ("spans", "score", "length", "start", "offset", "bucket", "edge", "_id", "_set", "host", "w", "lines", "n_words", "kept")}
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars int").withColumns(clash)


def test_documents_with_odd_rows(spark):
    docs = documents(spark)
    n = docs.count()
    order = lambda rows: sorted(map(str, rows))
    ids = order(r.doc_id for r in docs.select("doc_id").collect())
    assert order(r.doc_id for r in secrets.digests(secrets.scan(docs)).collect()) == ids
    assert order(r.doc_id for r in host_rules.apply_rules(docs).collect()) == ids
    assert order(r.doc_id for r in spotsigs.edits(docs).collect()) == ids
    none = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    assert order(r.doc_id for r in toxicity.score(docs, toxicity.fit(docs, none)).collect()) == ids
    assert order(r.doc_id for r in mil_quality.score(docs, mil_quality.fit(docs, none)).collect()) == ids
    for kept in (toxicity.keep_documents(docs, none), secrets.redact(docs), host_rules.keep_documents(docs)):
        assert kept.columns == docs.columns and kept.count() <= n
    pieces = packing.pack(docs).collect()
    whole = [p for p in pieces if p.start == 0]
    assert order(p.doc_id for p in whole) == ids
    assert sum(p.length for p in pieces) == sum(p.doc_tokens for p in whole)
    by_sequence = {}
    for p in pieces:
        by_sequence.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for own in by_sequence.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length


def test_signatures_change_little_with_small_edits():
    base = "the river runs to the old mill and the miller is at the gate with a lamp in his hand".split()
    for cut in range(8, len(base)):
        text = " ".join(base[:cut])
        a, b = spotsigs.signatures(text), spotsigs.signatures(text + " tonight")
        assert spotsigs.jaccard(a, b) > 0 and spotsigs.jaccard(a, a) == 1
    assert len(spotsigs.signatures("")) == 0 and len(spotsigs.signatures(" \n")) == 1 and len(spotsigs.signatures("word")) == 1
