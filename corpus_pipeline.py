"""A training-data pipeline over `documents`: each stage is one operator of quire.llm and works on all that the stage
before it kept. Stages but the last return the columns of `documents`."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quire.llm import minhash, packing, pii, suffixes, toxicity
from quire.llm.common import crc_mod, table


#: Passages of so many bytes that repeat are cut: some 35 to 50 words of the languages at hand.
PASSAGE_BYTES = 200


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the class-conditional models call toxic; they learn from the labelled documents that are not held out.

    Null texts count as empty and are scored like empty ones; long texts are read whole; repeated rows and ids are judged
    row by row; ties at the bar go; an empty table gives none; without labels of both classes all rows score the share of
    toxic labels. Columns beside id and text are kept unread."""
    taught = crc_mod("doc_id", 5) != 0
    model = toxicity.fit(docs.where(taught), table(spark, sf_dir, "labels").where(taught))
    return toxicity.keep_clean(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a shingle similarity of 0.8 or more, the one with the smallest id stays.

    Null and empty texts link with nothing and stay; rows without an id stay only if no row with an id is like them; of
    rows that repeat an id one stays; long texts are compared whole; an empty table gives none. Other columns are kept."""
    return minhash.deduplicate(docs, threshold=(80, 100))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts out every string of PASSAGE_BYTES bytes that also starts elsewhere, at all its places.

    Null and empty texts stay as they are; a text that repeats whole is left empty; n_chars is renewed where a text
    changed; repeated rows are repeats like others; an empty table gives none. Other columns are kept unread."""
    return suffixes.drop_repeats(docs, size=PASSAGE_BYTES)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts a mark of its kind in the place of each piece of personal data.

    Null and empty texts stay; overlapping finds get one mark, named by the first; n_chars is renewed where a text changed;
    rows are treated one by one, whatever repeats; an empty table gives none. Other columns are kept unread."""
    return pii.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the token ids of all documents into sequences of 2048.

    A null or empty text is its end id alone; long texts are cut at windows; ids may be null or repeat, each row is a
    document; an empty table gives no piece. Other columns are not read."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", reject_toxic),
    ("minhash", drop_near_duplicates),
    ("suffixes", cut_repeats),
    ("pii", redact_personal_data),
    ("packing", pack_sequences),
]

#: Most stages have no SQL form; tests/llm holds each operator, and the chain on a small table, against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
