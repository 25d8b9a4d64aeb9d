"""The registered queries: the contract's columns, SQL, brute force, and the pipeline stage by stage."""

import re

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from stridewell.llm import host_rules, minhash_dedup, packing, queries, secrets, toxicity

SMALL = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_secrets": "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string",
    "op2_minhash_dedup": "doc_id bigint, n_shingles bigint, component_id bigint, kept boolean",
    "op3_packing": "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
    "op4_warc": "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint",
    "op5_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op6_mil_quality": "doc_id bigint, held_out boolean, score double, predicted int",
    "op7_byte_bpe": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op8_spotsigs": "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    "op9_html_main": "page_id bigint, url string, text string, n_chars bigint",
    "op10_host_rules": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
    "op12_lattice_dedup": "vec_id bigint, n_links bigint, component_id bigint, kept boolean",
}
TABLES = {"op4_warc": "pages", "op9_html_main": "pages", "op12_lattice_dedup": "embeddings"}
#: Reports: their rows are not those of a table.
REPORTS = {
    "op11_filter_audit": "part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, unique_fails bigint, good_lost bigint, toxic_lost bigint, shapley bigint",
    "op13_hard_negatives": "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint",
}


@pytest.mark.parametrize("name", sorted(REPORTS))
def test_columns_of_reports(spark, name):
    assert queries.QUERIES[name](spark, SMALL).dtypes == [tuple(c.split()) for c in REPORTS[name].split(", ")]


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_of_the_contract(spark, name):
    found = queries.QUERIES[name](spark, SMALL)
    wanted = [tuple(c.split()) for c in COLUMNS[name].split(", ")]
    assert found.dtypes[: len(wanted)] == wanted
    table = TABLES.get(name, "documents")
    rows = spark.read.parquet(f"{SMALL}/{table}.parquet")
    key = found.columns[0]
    assert sorted(r[0] for r in found.select(key).distinct().collect()) == sorted(r[0] for r in rows.select(key).distinct().collect())
    assert name == "op3_packing" or found.count() == rows.count()


def hosts(spark):
    """Hosts with few failures, and one, bad, whose documents nearly all fail."""
    good = lambda k: " ".join(f"w{k}x{j}" for j in range(60))
    rows = [(1000 * h + k, "too short" if (h + k) % 13 == 0 else good(1000 * h + k), f"host{h}") for h in range(12) for k in range(30)]
    rows += [(90_000 + k, good(k) if k < 4 else "bad page", "bad") for k in range(60)]
    rows += [(95_000, good(1), "tiny"), (95_001, "bad page", "tiny"), (95_002, None, None), (95_003, good(2), None)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_host_verdict_flips_the_planted_host(spark):
    got = {r.doc_id: r for r in host_rules.apply_rules(hosts(spark)).collect()}
    refused = {r.host for r in got.values() if r.host_refused}
    assert refused == {"bad"}
    assert not any(got[90_000 + k].kept for k in range(60)) and not got[90_000].base_failed
    assert all(r.kept != r.base_failed for r in got.values() if r.host != "bad")
    clash = hosts(spark).withColumn("kept_id", F.lit(1)).withColumn("kept_hash", F.lit(1)).withColumn("host", F.lit("x"))
    kept = host_rules.keep_documents(clash)
    assert kept.columns == clash.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.kept}


def test_host_rules_equal_sql(spark, tmp_path):
    hosts(spark).write.parquet(f"{tmp_path}/documents.parquet")
    for folder in (SMALL, str(tmp_path)):
        with duckdb.connect() as duck:
            duck.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet{'/*.parquet' if folder != SMALL else ''}')")
            want = duck.execute(queries.HOST_RULES_SQL).df()
        got = host_rules.op10_host_rules(spark, folder).toPandas()
        order = lambda d: d[sorted(d.columns)].sort_values("doc_id").reset_index(drop=True)
        pd.testing.assert_frame_equal(order(got), order(want), check_dtype=False)


def components_by_all_pairs(texts: dict[int, str], size: int) -> dict[int, int]:
    """Components with every pair of documents compared through a list of all shingles."""
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()
    holders: dict = {}
    name = {i: i for i in texts}

    def find(i):
        while name[i] != i:
            i = name[i]
        return i

    for i in sorted(sets):
        counts: dict[int, int] = {}
        for s in sets[i]:
            for j in holders.setdefault(s, []):
                counts[j] = counts.get(j, 0) + 1
            holders[s].append(i)
        for j, n in counts.items():
            if 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n) and find(i) != find(j):
                name[max(find(i), find(j))] = min(find(i), find(j))
    return {i: find(i) for i in texts}


def test_near_duplicates_equal_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    for size in (2, 5):
        got = {r.doc_id: r.component_id for r in minhash_dedup.components(docs, size=size).collect()}
        assert got == components_by_all_pairs(texts, size)


def test_near_duplicates_of_large_groups(spark):
    """Chains and stars of edited copies, long ones beyond the sketch, with passages that all share."""
    rng = np.random.default_rng(11)
    passage = [f"shared{k}" for k in range(90)]
    texts, k = {}, 0
    for group, length in enumerate((40, 120, 400, 900)):
        base = [f"g{group}w{j}" for j in range(length)] + passage
        for copy in range(40):
            words = list(base)
            for at in rng.choice(len(words), int(len(words) * rng.uniform(0, 0.09)), replace=False):
                words[at] = f"edit{k}n{at}"
            texts[k] = " ".join(words)
            k += 1
    texts |= {k + j: " ".join([*passage, *(f"own{j}n{m}" for m in range(10 + j))]) for j in range(40)}
    table = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    for size in (2, 5):
        got = {r.doc_id: r.component_id for r in minhash_dedup.components(table, size=size).collect()}
        assert got == components_by_all_pairs(texts, size)


def pipeline_rows(spark):
    clean = lambda k: " ".join(f"word{k}n{j}" for j in range(70))
    near = clean(3).split()
    near[69] = "edited"
    rows = [(k, clean(k)) for k in range(20)]
    rows += [(30, " ".join(near)), (31, clean(4).upper()), (32, clean(32) + ' api_key = "abcdefghijkl123"'), (33, "short"), (34, None), (35, ""), (36, clean(36) + " vile" * 3), (36, clean(37)), (None, clean(38)), (None, clean(39)), (40, "same " * 200)]
    return spark.createDataFrame([(i, t, "en", "h", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars int").withColumn("kept_id", F.lit(7)).repartition(3)


def test_pipeline_stage_by_stage(spark, tmp_path):
    """Each stage keeps what a plain rule keeps, and its decisions reach the next."""
    labels = spark.createDataFrame([(k, 1, int(k % 2)) for k in range(1000, 1400)], "doc_id long, quality int, toxic int")
    train = spark.createDataFrame([(k, " ".join(f"t{(k * 3 + j) % 40}" for j in range(60)) + (" vile" if k % 2 else ""), "en", "h", 0, 7) for k in range(1000, 1400)], pipeline_rows(spark).schema)
    docs = pipeline_rows(spark).unionByName(train)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    by_name, at, kept = dict(corpus_pipeline.STAGES), spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    assert list(by_name) == ["toxicity", "quality_rules", "near_duplicates", "secrets", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, at, str(tmp_path))
        assert name == "packing" or out.dtypes == at.dtypes
        out.write.parquet(f"{tmp_path}/{name}")
        at = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = at.collect()
    texts = lambda rows: sorted((str(r.doc_id), r.text or "") for r in rows)
    model = toxicity.fitted(toxicity.fit(docs, labels))
    score = toxicity.Scorer(model).scores([r.text or "" for r in docs.collect()])
    assert texts(kept["toxicity"]) == texts(r for r, s in zip(docs.collect(), score, strict=True) if s < 0.5)
    assert not any("vile" in (r.text or "") for r in kept["toxicity"])

    def failed(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        runs = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        many = {k + d for k, r in enumerate(runs) if runs.count(r) > 1 for d in range(3)}
        return len(w) < 50 or 100 * len(many) > 50 * len(w)

    assert texts(kept["quality_rules"]) == texts(r for r in kept["toxicity"] if not failed(r.text))
    rows = sorted(kept["quality_rules"], key=lambda r: (r.doc_id is None, r.doc_id or 0))
    component = components_by_all_pairs({k: r.text for k, r in enumerate(rows)}, 5)
    assert texts(kept["near_duplicates"]) == texts(r for k, r in enumerate(rows) if component[k] == k)
    enc = secrets.encoder(secrets.vocabulary())
    assert texts(kept["secrets"]) == sorted((str(r.doc_id), secrets.redacted(r.text, enc)) for r in kept["near_duplicates"])
    assert any("[assign]" in r.text for r in kept["secrets"]) and all(r.n_chars == len(r.text) for r in kept["secrets"])
    lengths = sorted(n for n in (r.doc_tokens for r in kept["packing"] if r.start == 0))
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.tokenizer_path())
    assert lengths == sorted(len(t.encode(r.text, add_special_tokens=False).ids) + 1 for r in kept["secrets"])


def test_pipeline_runs_on_tables(spark, tmp_path):
    assert corpus_pipeline.run(spark, SMALL).count() > 0
    for name in ("documents", "labels"):
        spark.read.parquet(f"{SMALL}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
