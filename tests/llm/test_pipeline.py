"""The stages, one by one on awkward rows, and the whole run."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from .data import document_rows, documents

CLASH = ["_text", "_h", "_spans", "_size", "_quality_score", "_row", "mix_taken", "component_id", "key", "hits", "span"]


@pytest.fixture
def tables(spark, tmp_path):
    rows = document_rows()
    documents(spark, rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    bench = [(1, " ".join(rows[10][1].split()[:10])), (2, None)]
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    labels = [(r[0], 1, 0) for r in rows if r[0] is not None]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_stages_keep_columns_that_clash(spark, tables):
    docs = documents(spark).withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in CLASH})
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, tables)
        last = name == corpus_pipeline.STAGES[-1][0]
        assert out.columns == docs.columns or last and set(out.columns) == {*docs.columns, "mix_slices"}
        kept = [c for c in CLASH if not (last and c == "mix_taken")]
        assert out.where(F.col("doc_id").isNotNull() & ~F.array_contains(F.array(*(F.col(c) == F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in kept)), False)).count() == out.where("doc_id is not null").count()
        assert out.count() > 0


def test_stages_bear_empty_tables(spark, tables):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, documents(spark, []), tables).count() == 0


def test_run(spark, tables):
    out = corpus_pipeline.run(spark, tables)
    ids = [r["doc_id"] for r in out.select("doc_id").collect()]
    named = [i for i in ids if i is not None]
    assert len(set(named)) == len(named) and 10 not in named and 205 not in named
    assert len([i for i in named if 100 <= i < 106]) <= 1
    assert out.where("mix_taken <= 0").isEmpty()
