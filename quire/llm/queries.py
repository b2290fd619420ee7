"""The queries of the subpackage: each applies an operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import crc_mod, table


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), threshold=(85, 100))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm import pii

    return pii.digests(pii.find(table(spark, sf_dir, "documents")))


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm import langid

    docs = table(spark, sf_dir, "documents")
    prototypes = langid.learn(docs.where(crc_mod("doc_id", 4) != 2))
    held_out = F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False)).alias("held_out")
    return langid.predict(docs, prototypes).select("doc_id", held_out, "lang_pred", "score")


def _teaching(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Rows whose labels may be learned: those whose crc32 remainder is not 0."""
    return table(spark, sf_dir, name).where(crc_mod("doc_id", 5) != 0)


def _judged(scored: DataFrame, bar: float) -> DataFrame:
    held_out = F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False)).alias("held_out")
    return scored.select("doc_id", held_out, "score", (F.col("score") >= bar).cast("int").alias("predicted"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm import nbsvm

    model = nbsvm.fit(_teaching(spark, sf_dir, "documents"), _teaching(spark, sf_dir, "labels"), "quality")
    return _judged(nbsvm.score(table(spark, sf_dir, "documents"), model), 0.3)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm import toxicity

    model = toxicity.fit(_teaching(spark, sf_dir, "documents"), _teaching(spark, sf_dir, "labels"))
    return _judged(toxicity.score(table(spark, sf_dir, "documents"), model), 0.5)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from quire.llm import packing

    pieces = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), keep_ids=False)
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from quire.llm import pieces

    return pieces.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), output="digest")


def op9_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm import forest

    return forest.search(table(spark, sf_dir, "embeddings"), every=100, k=10)


def op10_pstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm import pstable

    return pstable.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.9)


def op6_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm import suffixes

    return suffixes.removals(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op6_suffixes": op6_suffixes,
    "op7_quality": op7_quality,
    "op8_packing": op8_packing,
    "op9_forest": op9_forest,
    "op10_pstable": op10_pstable,
    "op2_pii": op2_pii,
    "op3_pieces": op3_pieces,
    "op4_langid": op4_langid,
    "op5_minhash": op5_minhash,
}
