"""The registered queries over the smallest tables, and the pipeline stage by stage."""

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from strandloom.llm import jaccard, registry
from strandloom.llm.storage import read

SF = "/root/testdata/sf0.001"


def test_names():
    names = list(registry.queries())
    assert [int(n[2:].split("_")[0]) for n in names] == list(range(1, 14))


@pytest.mark.parametrize("name", list(registry.oracles()))
def test_oracles(spark, name):
    con = duckdb.connect()
    for t in ("embeddings", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want, got = con.sql(registry.oracles()[name]).df(), registry.queries()[name](spark, SF).toPandas()
    key = sorted(want.columns)
    assert sorted(got.columns) == key
    text = lambda f: sorted(map(str, f[key].astype(object).where(f[key].notna(), None).values.tolist()))
    assert text(want) == text(got)


def test_quality_held_out_accuracy(spark):
    got = registry.op3_quality(spark, "/root/testdata/sf0.01").join(read(spark, "/root/testdata/sf0.01", "labels"), "doc_id").filter("held_out").toPandas()
    assert (got["predicted"] == got["quality"]).mean() > 0.85


def test_language_held_out_accuracy(spark):
    docs = read(spark, SF, "documents").select("doc_id", "lang")
    got = registry.op8_language(spark, SF).join(docs, "doc_id").filter("held_out").toPandas()
    assert (got["lang_pred"] == got["lang"]).mean() > 0.97


def test_pipeline(spark):
    docs = read(spark, SF, "documents")
    columns, ids = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_copies", "decontamination", "secrets", "mixing"]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        rows = out.toPandas()
        assert set(rows["doc_id"]) <= ids and rows["doc_id"].is_unique
        if name != "mixing":
            assert out.columns == columns
            docs = spark.createDataFrame(rows, docs.schema)
        if name == "near_copies":
            assert jaccard.join(docs).filter(F.col("doc_id") != F.col("component_id")).count() == 0
        if name == "secrets":
            assert not rows["text"].str.contains(r'token = "[0-9a-f]{40}"').any()
        ids = set(rows["doc_id"])
    assert np.isclose(rows["taken"].sum(), 1.5 * rows["size"].sum(), rtol=0.01)
    final = corpus_pipeline.run(spark, SF).toPandas()
    pd.testing.assert_frame_equal(final.sort_values("doc_id", ignore_index=True), rows.sort_values("doc_id", ignore_index=True))
