"""Command line: python -m plumbline index|search|why|stats|bench."""

from __future__ import annotations

import argparse
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from plumbline.functions.vectors import preview
from plumbline.operators import evaluate
from plumbline.operators.store import VectorStore
from plumbline.schema import SearchConfig
from plumbline.sources import files

DEFAULT_DIMENSIONS = 384


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="plumbline", description=__doc__)
    sub = parser.add_subparsers(dest="command", required=True)
    index = sub.add_parser("index", help="store the vectors of a JSON-lines file")
    index.add_argument("input")
    index.add_argument("store")
    search = sub.add_parser("search", help="search a store for a vector: a JSON array or a .json file")
    search.add_argument("store")
    search.add_argument("query")
    search.add_argument("--limit", type=int, default=10)
    search.add_argument("--rerank", action="store_true", help="rerank by the structure of neighbourhoods")
    why = sub.add_parser("why", help="how a search for a vector judges a node")
    why.add_argument("store")
    why.add_argument("query")
    why.add_argument("node", type=int)
    stats = sub.add_parser("stats", help="sizes of a store")
    stats.add_argument("store")
    bench = sub.add_parser("bench", help="time searches of a store for its own vectors")
    bench.add_argument("store")
    bench.add_argument("--queries", type=int, default=10)
    a = parser.parse_args(args)
    spark = SparkSession.builder.appName("plumbline").getOrCreate()
    if a.command == "index":
        first = spark.read.text(a.input).select(F.size(F.from_json("value", "embedding array<float>")["embedding"]).alias("n")).filter("n > 0").first()
        dim = first["n"] if first else DEFAULT_DIMENSIONS
        rows = files.read_jsonl(spark, a.input, dim).withColumn("seq", F.monotonically_increasing_id())
        done = VectorStore(spark, a.store, dim).ingest(rows)
        print(f"{done.filter('error is null').count()} vectors of {dim} dimensions")
        return
    known = VectorStore(spark, a.store, 0).snapshot().select(F.size("embedding").alias("n")).first()
    store = VectorStore(spark, a.store, known["n"] if known else DEFAULT_DIMENSIONS)
    if a.command == "search":
        query = files.vector_literal(spark, a.query)
        if query is None:
            parser.error("the query is no JSON array")
        found = store.search(query, SearchConfig(a.limit, enable_reranking=a.rerank, order_by="d_total" if a.rerank else "score"))
        found.select("rank", "id", "score", preview("metadata.extra", "metadata.source").alias("text")).orderBy("rank").show(a.limit, truncate=False)
    elif a.command == "why":
        query = files.vector_literal(spark, a.query)
        if query is None:
            parser.error("the query is no JSON array")
        for name, value in store.why(query, a.node).items():
            print(f"{name}: {value}")
    elif a.command == "stats":
        store.stats(true_hubs=True).show(truncate=False)
    else:
        took = []
        for row in store.snapshot().select("embedding").limit(a.queries).collect():
            began = time.perf_counter()
            store.search(row["embedding"], SearchConfig(10, enable_reranking=False)).collect()
            took.append((1e6 * (time.perf_counter() - began),))
        if took:
            rows = evaluate.percentile(spark.createDataFrame(took, "us double"), "us", [50, 95, 99]).orderBy("percent").collect()
            print(evaluate.results_table([{"percentile": r["percent"], "microseconds": r["value"]} for r in rows]))


if __name__ == "__main__":
    main()
