"""A corpus pipeline of the text operators: language ID, quality rules, near-dedup, mixing, packing.

Every stage takes (spark, docs, sf_dir) and returns a frame that is written as
Parquet and read again as the next stage's docs. All but the last return the
columns of documents. A stage works on all rows that its predecessor kept.

Defined results, of every stage: rows are judged, not ids, so ids may repeat or be
null; columns beside those of documents go along, whatever their names; an empty
table gives an empty one. A text of any length is taken whole.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import langid, mixing, neardup, packing, quality
from plumbline.llm.common import read, shared_folder

#: Texts whose language's posterior is lower are rejected.
LEAST_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose language can be told: with a letter, and a posterior of at least LEAST_SCORE. A null or empty text, or one without a letter, goes. At
    equal posteriors the first language in order counts; without labelled texts to learn from, no language can be told and all go."""
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    model = langid.train(docs.filter(~F.coalesce(held_out, F.lit(False))))
    return langid.kept_rows(docs, model, LEAST_SCORE)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that pass the base rules and the log-likelihood ratio. A null text has no words and goes; a score at the threshold stays; without trusted
    texts the base rules alone decide."""
    trusted = read(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    model = quality.fit(docs, trusted)
    return quality.kept_rows(docs, model)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group, the one with the least id, null being the greatest. Null and empty texts are in no group and stay."""
    return neardup.kept_rows(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as the mix does: not at all, once or twice. A null source is one of its own; documents without a word go along with their source's
    whole copies; of equal texts, which are taken is open."""
    return mixing.mixed_rows(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into sequences, a row per piece; a null text is one piece of its end id alone. Repeated rows are packed each."""
    return packing.pack_documents(docs)


STAGES = [
    ("language ID", language_id),
    ("quality rules", quality_rules),
    ("MinHash near-dedup", near_dedup),
    ("mixing to target weights", mix_sources),
    ("best-fit packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents."""
    folder = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs


#: Tokens, signatures and the budgets' dynamic program aren't for SQL; the tests compare with a version in plain Python.
ORACLE_SQL = None
