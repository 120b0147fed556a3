"""Texts travel to Python in small batches, whatever the session's setting."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from panelspark.llm import common, mixing, neardup, packing, toxicity
from panelspark.llm.common import BATCH_ROWS, small_batches, table

SF = "/root/testdata/sf0.001"
SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def largest_batch(spark):
    sizes = spark.range(0, 3000, 1, 1).mapInPandas(
        lambda batches: (pd.DataFrame({"n": [len(b)]}) for b in batches), "n long"
    )
    return sizes.agg(F.max("n")).first()[0]


def test_batches_are_small_inside_only(spark):
    before = spark.conf.get(SETTING)
    with small_batches(spark):
        assert largest_batch(spark) == BATCH_ROWS
        with small_batches(spark, 70):
            assert largest_batch(spark) == 70
        with small_batches(spark, 9000):  # the smaller setting stays
            assert largest_batch(spark) == BATCH_ROWS
    assert spark.conf.get(SETTING) == before
    with pytest.raises(ZeroDivisionError), small_batches(spark):
        raise ZeroDivisionError
    assert spark.conf.get(SETTING) == before


def test_scores_need_no_arrow_batch(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    for df in (toxicity.drop_toxic(docs, labels), toxicity.score_documents(docs, toxicity.Model())):
        plan = df._jdf.queryExecution().toString()
        assert "BatchEvalPython" in plan and "ArrowEvalPython" not in plan


def test_stages_that_read_whole_texts_write_in_small_batches(spark, monkeypatch):
    seen = {}

    def noted(name):
        seen.setdefault(name, set()).add(int(spark.conf.get(SETTING)))

    write = common.Stages.write
    monkeypatch.setattr(common.Stages, "write", lambda self, df, name: noted(name) or write(self, df, name))
    for module in (mixing, packing):
        monkeypatch.setattr(module, "stage", lambda df, name: noted(name) or common.stage(df, name))
    before = int(spark.conf.get(SETTING))
    docs = table(spark, SF, "documents")
    for name, function in corpus_pipeline.STAGES[2:]:
        function(spark, docs, SF)
    assert neardup.Stages is common.Stages
    for name in ("nodes", "verified", "mix-rows", "pieces"):
        assert seen[name] == {BATCH_ROWS}
    assert seen["rows"] == seen["lengths"] == {before} and int(spark.conf.get(SETTING)) == before
