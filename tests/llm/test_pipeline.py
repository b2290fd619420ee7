"""The pipeline's stages, one after the other, on tables with odd rows."""

import pytest

import corpus_pipeline
from tests.llm.conftest import DOCS
from tests.llm.test_texts import insult, learnable


@pytest.fixture(scope="module")
def folder(spark, odd_rows, tmp_path_factory):
    d = tmp_path_factory.mktemp("data")
    docs, labels = learnable(spark, insult)
    odd = spark.createDataFrame([((r[0] + 5000) if r[0] else None, *r[1:]) for r in odd_rows], DOCS)
    mail = spark.createDataFrame([(9000, "write to someone@example.com soon", "en", "s", 33, *(None,) * 5)], DOCS)
    docs.union(odd).union(mail).write.parquet(f"{d}/documents.parquet")
    labels.withColumnRenamed("y", "toxic").write.parquet(f"{d}/labels.parquet")
    return str(d)


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "packing":
            assert docs.columns == columns
            kept[name] = {r.doc_id: r.text for r in docs.collect()}
    toxic = {r.doc_id for r in spark.read.parquet(f"{folder}/documents.parquet").where("text like '%vequ%' or text like '%zork%'").collect()}
    assert len(toxic & kept["toxicity"].keys()) < 0.15 * len(toxic)  # seen in a few hundred texts only
    assert {5001, 5005, 5007} <= kept["minhash"].keys() and not {5002, 5003, 5004, 5006, 5011} & kept["minhash"].keys()
    assert kept["suffixes"].keys() == kept["minhash"].keys()
    assert kept["pii"][9000] == "write to [EMAIL] soon"
    assert {r.doc_id for r in docs.select("doc_id").collect()} == kept["pii"].keys()


def test_run(spark, folder):
    assert corpus_pipeline.run(spark, folder).count() > 0
    assert corpus_pipeline.ORACLE_SQL is None


def test_empty_tables(spark, folder, nothing, tmp_path):
    """No documents, or no labels: every stage gives a table, with the columns of documents but for the last."""
    nothing.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert out.count() == 0 and (name == "packing" or out.columns == docs.columns)
    clean = corpus_pipeline.reject_toxic(spark, spark.read.parquet(f"{folder}/documents.parquet"), str(tmp_path))
    assert clean.count() == spark.read.parquet(f"{folder}/documents.parquet").count()
