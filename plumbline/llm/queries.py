"""The queries of the text operators: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read
from .neardup import ORACLE as NEAR_ORACLE
from .url_rules import ORACLE as URL_ORACLE


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(read(spark, sf_dir, "documents"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import token_counts

    return token_counts(read(spark, sf_dir, "documents"))


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_rules import filter_urls

    return filter_urls(read(spark, sf_dir, "pages"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard

    return shard(read(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality

    return quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels").filter("quality = 1").select("doc_id"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neardup import near_duplicates

    return near_duplicates(read(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import identify, train

    docs = read(spark, sf_dir, "documents")
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    model = train(docs.filter(~F.coalesce(held_out, F.lit(False))))
    found = identify(docs, model)
    return found.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .media import read_media, to_media

    stored = to_media(read(spark, sf_dir, "documents"))
    back = read_media(stored.select(F.struct("doc_id", "n_bytes").alias("key"), "media"), id_col="key")
    spans = F.transform("clips", lambda c: F.concat_ws("-", c["first_frame"], c["first_frame"] + c["frames"]))
    return back.select(
        F.col("doc_id.doc_id").alias("doc_id"), F.col("doc_id.n_bytes").alias("n_bytes"), F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"), F.crc32(F.expr("substring(payload, -64, 64)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"),
        F.concat(F.lit("frames="), F.col("n_frames"), F.lit(";shots="), F.size("clips"), F.lit(";clips="), F.array_join(spans, ",")).alias("feature"),
    )


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import extract

    return extract(read(spark, sf_dir, "pages"))


QUERIES = {"op1_best_fit_packing": op1_best_fit_packing, "op2_mixing": op2_mixing, "op3_token_counts": op3_token_counts, "op6_url_filters": op6_url_filters, "op8_sharding": op8_sharding, "op10_quality_rules": op10_quality_rules, "op4_near_duplicates": op4_near_duplicates, "op5_language_id": op5_language_id, "op7_media_columns": op7_media_columns, "op9_html_extraction": op9_html_extraction}

#: DuckDB SQL for the queries that SQL can express.
ORACLES: dict[str, str] = {"op4_near_duplicates": NEAR_ORACLE, "op6_url_filters": URL_ORACLE}
