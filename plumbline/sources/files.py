"""File formats of vector data: fvecs and ivecs records, JSON lines, vector literals."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Files of more bytes are read by several tasks.
RANGE = 32_000_000


def read_vecs(spark: SparkSession, path: str, integers: bool = False, range_bytes: int = RANGE) -> DataFrame:
    """(file, pos, v) of records of a little-endian int32 count and as many float32 (fvecs) or uint32 (ivecs) values. A record cut off at a file's end is left out.
    Files up to ``range_bytes``, and those that aren't whole records of the first one's length, are read by a task each; larger ones by Spark's reader of
    fixed-length records, in ranges."""
    kind = f"file string, pos long, v array<{'bigint' if integers else 'float'}>"
    large: dict[str, int] = {}
    for row in spark.read.format("binaryFile").load(path).filter(F.col("length") > range_bytes).select("path", "length").collect():  # a row per large file
        size = 4 + 4 * int.from_bytes(_first_bytes(spark, row["path"], 4), "little", signed=True)
        if size >= 4 and row["length"] % size == 0:
            large[row["path"]] = size
    files = spark.read.format("binaryFile").load(path)
    if large:
        files = files.filter(~F.col("path").isin(list(large)))
    out = files.select("path", "content").mapInArrow(_whole_files(integers), kind)
    for name, size in large.items():
        numbered = spark.sparkContext.binaryRecords(name, size).zipWithIndex().map(lambda x: (x[1], bytes(x[0])))
        out = out.unionByName(spark.createDataFrame(numbered, "pos long, raw binary").mapInArrow(_fixed_records(name, size, integers), kind))
    return out


def _first_bytes(spark: SparkSession, path: str, n: int) -> bytes:
    """The first bytes of a file, by the file system of its path."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = at.getFileSystem(spark._jsc.hadoopConfiguration()).open(at)
    try:
        return bytes(stream.readByte() & 0xFF for _ in range(n))
    finally:
        stream.close()


def _fixed_records(name: str, size: int, integers: bool):
    """A task's function from (pos, raw) to (file, pos, v)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, size)
            dims = table[:, :4].copy().view("<i4")[:, 0]
            if (4 + 4 * dims != size).any():
                raise ValueError(f"{name} has records of {size} and of other lengths; split it into smaller files")
            values = table[:, 4:].copy().view("<u4" if integers else "<f4")
            flat = pa.array(values.ravel().astype(np.int64 if integers else np.float32))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(table) + 1, dtype=np.int32) * (size // 4 - 1)), flat)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(table)), batch.column(0), lists], names=["file", "pos", "v"])

    return run


def _whole_files(integers: bool):
    """A task's function from (path, content) to (file, pos, v)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = np.dtype("<u4" if integers else "<f4")
        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                at, pos, held = 0, 0, []
                while at + 4 <= len(raw):
                    dim = int.from_bytes(raw[at : at + 4], "little", signed=True)
                    if dim < 0 or at + 4 + 4 * dim > len(raw):
                        break
                    held.append((pos, np.frombuffer(raw, kind, dim, at + 4)))
                    at, pos = at + 4 + 4 * dim, pos + 1
                    if len(held) == 8192:
                        yield made(name, held)
                        held = []
                if held:
                    yield made(name, held)

    def made(name: str, held: list) -> pa.RecordBatch:
        values = pa.array([x.astype(np.int64 if integers else np.float32) for _, x in held], pa.list_(pa.int64() if integers else pa.float32()))
        return pa.RecordBatch.from_arrays([pa.array([name] * len(held)), pa.array([p for p, _ in held], pa.int64()), values], names=["file", "pos", "v"])

    return run


@dataclass
class VectorBundle:
    """A benchmark's base vectors, queries and ground truth."""

    base: DataFrame
    queries: DataFrame
    truth: DataFrame


def read_bundle(spark: SparkSession, folder: str, name: str) -> VectorBundle:
    """Reads name_base.fvecs, name_query.fvecs and name_groundtruth.ivecs of a folder."""
    part = lambda kind: f"{folder.rstrip('/')}/{name}_{kind}"
    base, query = (read_vecs(spark, part(k)) for k in ("base.fvecs", "query.fvecs"))
    truth = read_vecs(spark, part("groundtruth.ivecs"), integers=True).select(F.col("pos").alias("qid"), F.posexplode("v").alias("rank", "id"))
    return VectorBundle(base.select(F.col("pos").alias("id"), "v"), query.select(F.col("pos").alias("qid"), F.col("v").alias("q")), truth.select("qid", "id", (F.col("rank") + 1).cast("long").alias("rank")))


def parse_lines(lines: DataFrame, dimensions: int, source: str = "index") -> DataFrame:
    """(embedding, metadata) of JSON lines (column value) with text and embedding; broken lines, lines without an embedding or of another length are left out. The timestamp is that of the reading, in seconds."""
    row = F.from_json("value", "text string, embedding array<float>", {"mode": "PERMISSIVE"})
    df = lines.select(row.alias("r")).filter(F.size("r.embedding") == dimensions)
    meta = F.struct(F.unix_timestamp().alias("timestamp"), F.lit(source).alias("source"), F.array().cast("array<string>").alias("tags"), F.create_map(F.lit("text"), F.coalesce("r.text", F.lit(""))).alias("extra"))
    return df.select(F.col("r.embedding").alias("embedding"), meta.alias("metadata"))


def read_jsonl(spark: SparkSession, path: str, dimensions: int, source: str = "index") -> DataFrame:
    """parse_lines over text files."""
    return parse_lines(spark.read.text(path), dimensions, source)


def vector_literal(spark: SparkSession, text: str) -> list[float] | None:
    """A vector given as a JSON array, or as the path of a .json file that holds one."""
    if text.strip().endswith(".json"):
        text = spark.read.option("wholetext", True).text(text.strip()).first()[0]
    return spark.range(1).select(F.from_json(F.lit(text), "array<float>")).first()[0]
