"""The pipeline's stages hand whole texts to Python in short Arrow batches."""

import pytest

import corpus_pipeline
from stridewell.llm.common import BATCH_ROWS, short_batches

ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


@pytest.fixture
def batches(spark):
    before = spark.conf.get(ROWS)
    yield spark
    spark.conf.set(ROWS, before)


def test_a_stage_of_texts_asks_for_short_batches(batches):
    batches.conf.set(ROWS, "10000")
    docs = batches.range(BATCH_ROWS + 500).selectExpr("id AS doc_id", "'a word' AS text").coalesce(1)
    kept = corpus_pipeline.redact_secrets(batches, docs, "")
    sizes = kept.mapInArrow(lambda parts: (p.slice(0, 1).select(["doc_id"]).set_column(0, "n", [p.num_rows]) for p in parts), "n long")
    assert max(r.n for r in sizes.collect()) == BATCH_ROWS and kept.count() == BATCH_ROWS + 500


def test_a_smaller_number_stays(batches):
    for asked, want in (("7", "7"), ("0", str(BATCH_ROWS)), ("-1", str(BATCH_ROWS)), ("10000", str(BATCH_ROWS))):
        batches.conf.set(ROWS, asked)
        short_batches(batches)
        assert batches.conf.get(ROWS) == want
