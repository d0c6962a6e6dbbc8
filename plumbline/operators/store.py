"""A vector store on Parquet: ingest, retrieve, vacuum, stats. Every change makes a new version; readers keep theirs."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions import vectors as V
from plumbline.operators import graph, topk, topology
from plumbline.plans.cutting import cut
from plumbline.plans.tables import Versions
from plumbline.schema import METADATA, DimensionMismatch, NodeNotFound, SearchConfig, StorageError

HNSW_FIXED, HNSW_DEGREE = 68, 32


def retrieve(queries: DataFrame, vectors: DataFrame, config: SearchConfig, ego_stats: DataFrame | None = None, live: DataFrame | None = None) -> DataFrame:
    """(qid, id, rank, score, d_total): the nearest by squared distance are candidates, dead ones (not in live) are left out beforehand,
    the rest is scored and, with ego_stats, reranked. queries: (qid, q), vectors: (id, v)."""
    if live is not None:
        vectors = vectors.join(live, "id", "left_semi")
    near = topk.top_k_bulk(queries, vectors, config.candidates, exclude_self=True)
    rows = near.select("qid", "id").join(vectors.select("id", "v"), "id").join(queries, "qid")
    rows = rows.select("qid", "id", V.retrieval_score("q", "v", config.score_mode).alias("score"))
    if config.enable_reranking and ego_stats is not None:
        rows = topology.rerank(rows.withColumn("cosine", 1 - F.col("score")), ego_stats, config.alpha, config.beta).select("qid", "id", "score", "d_total")
    else:
        rows = rows.withColumn("d_total", F.lit(None).cast("double"))
    by = [F.asc("d_total")] if config.order_by == "d_total" and config.enable_reranking and ego_stats is not None else [F.desc("score")]
    ranked = rows.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy(*by, "id")).cast("long"))
    return ranked.filter(F.col("rank") <= config.limit).select("qid", "id", "rank", "score", "d_total")


def memory_model(n: int, dim: int, degree: int = HNSW_DEGREE) -> dict[str, int]:
    """Bytes of a graph index, coarse bit planes and their sum with fixed costs."""
    index, planes = n * (4 * dim + 8 * degree + HNSW_FIXED), n * 9 * -(-dim // 8)
    return {"index_bytes": index, "bitplane_coarse_bytes": planes, "memory_usage_bytes": index + planes + 16 * n + 1024}


def combined_memory(n: int, dim: int, degree: int = 16, bits: int = 4) -> dict[str, int]:
    """Bytes of a combined index: graph, floats, codes."""
    parts = {"graph": n * degree * 2 * 8, "float": n * dim * 4, "codes": n * (dim * bits // 8 + 16)}
    return parts | {"total": sum(parts.values())}


class VectorStore:
    """Vectors of one dimension with metadata under a folder, in numbered versions. A version's neighbour graph and the statistics of its neighbourhoods are made when a
    search first reranks, kept beside it, and taken over by later versions for all nodes whose neighbourhood is the same."""

    def __init__(self, spark: SparkSession, folder: str, dimensions: int, degree: int = 16):
        self.spark, self.folder, self.dimensions, self.degree = spark, folder.rstrip("/"), dimensions, degree
        self.kept = Versions(spark, folder)

    def versions(self) -> list[int]:
        return self.kept.known()

    def snapshot(self, version: int | None = None) -> DataFrame:
        """(node_id, embedding, metadata) of a version, the latest by default."""
        found = self.versions()
        if version is not None and version not in found:
            raise StorageError(f"no version {version}")
        if not found:
            return self.spark.createDataFrame([], f"node_id long, embedding array<float>, metadata {METADATA}")
        return self.spark.read.parquet(f"{self.folder}/v{found[-1] if version is None else version}/vectors")

    def _publish(self, df: DataFrame) -> int:
        return self.kept.write({"vectors": df})

    def _vectors(self, version: int | None = None) -> DataFrame:
        return self.snapshot(version).select(F.col("node_id").alias("id"), F.col("embedding").alias("v"))

    def graph(self, hops: int = 1) -> tuple[DataFrame, DataFrame]:
        """The latest version's edges (src, dst, dist, rank) and neighbourhood statistics (ego, nv, ne, beta0, beta1, euler), read if they are kept, else made from the
        last ones that are, or anew. Above graph.EXACT_ROWS vectors the graph is approximate and made anew."""
        if not self.versions():
            raise StorageError("an empty store has no graph")
        version = self.versions()[-1]
        name = f"g{version}h{hops}"
        if not self.kept.exists(f"{name}/_DONE"):
            self._make_graph(version, hops, name)
        return tuple(self.spark.read.parquet(f"{self.folder}/{name}/{t}") for t in ("edges", "stats"))

    def _make_graph(self, version: int, hops: int, name: str) -> None:
        now = self._vectors(version)
        earlier = [v for v in self.versions() if v < version and self.kept.exists(f"g{v}h{hops}/_DONE")]
        exact = now.count() <= graph.EXACT_ROWS
        if earlier and exact:
            old_edges, old_stats = (self.spark.read.parquet(f"{self.folder}/g{earlier[-1]}h{hops}/{t}") for t in ("edges", "stats"))
            edges, changed = graph.knn_changes(old_edges, self._vectors(earlier[-1]), now, self.degree)
            egos = changed
            for _ in range(hops):  # who reaches a changed node sees other edges
                egos = egos.unionByName(edges.join(egos.withColumnRenamed("id", "dst"), "dst", "left_semi").select(F.col("src").alias("id"))).distinct()
            egos = cut(egos)
            same = old_stats.join(egos.withColumnRenamed("id", "ego"), "ego", "left_anti").join(now.select(F.col("id").alias("ego")), "ego", "left_semi")
            stats = cut(topology.ego_stats(edges, egos, hops)).unionByName(same)
            misses = egos.count()
        else:
            if exact:
                edges = cut(graph.knn_graph(now, self.degree))
            else:
                found = graph.build_partitioned(now, self.degree)
                edges = cut(topk.ranked(found, self.degree, "dist", "dst", "src"))
            stats = topology.ego_stats(edges, now.select("id"), hops)
            misses = now.count()
        self.kept.delete(name)
        edges.write.parquet(f"{self.folder}/{name}/edges")
        stats.write.parquet(f"{self.folder}/{name}/stats")
        self.spark.createDataFrame([(now.count() - misses, misses)], "hits long, misses long").write.parquet(f"{self.folder}/{name}/cache")
        self.kept.mark(name)

    def cache_stats(self) -> DataFrame:
        """One row (hits, misses, hit_rate): how many neighbourhoods' statistics were taken over and made, over all versions; the rate is in percent, 0 without any."""
        made = [n for n in self.kept.names() if n.startswith("g") and self.kept.exists(f"{n}/_DONE")]
        counts = self.spark.createDataFrame([], "hits long, misses long")
        if made:
            counts = self.spark.read.parquet(*(f"{self.folder}/{n}/cache" for n in made))
        df = counts.agg(*(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("hits", "misses")))
        return df.withColumn("hit_rate", F.when(F.col("hits") + F.col("misses") > 0, 100 * F.col("hits") / (F.col("hits") + F.col("misses"))).otherwise(F.lit(0.0)))

    def invalidate(self) -> None:
        """Forgets all kept graphs and statistics."""
        for n in self.kept.names():
            if n.startswith("g"):
                self.kept.delete(n)

    def checked(self, items: DataFrame) -> DataFrame:
        """Items (seq, embedding, metadata) with error, which is null for those that can be stored."""
        got = F.coalesce(F.size("embedding"), F.lit(0))
        return items.withColumn("error", F.when(got != self.dimensions, F.concat(F.lit(f"expected {self.dimensions} dimensions, got "), got)))

    def ingest(self, items: DataFrame) -> DataFrame:
        """Stores items (seq, embedding, metadata) in order of seq. Gives (seq, node_id, error), one row per item: node_id is null where error isn't.
        Ids go on from the greatest; the items' ranks are prefix sums over sorted parts, so no task sees all."""
        now = self.snapshot()
        first = (now.agg(F.max("node_id")).first()[0] if self.versions() else None)
        first = -1 if first is None else first
        done = self.checked(items)
        good = done.filter("error is null").repartitionByRange("seq").sortWithinPartitions("seq").withColumn("_part", F.spark_partition_id())
        good = cut(good)
        counts = good.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
        before = counts.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_before"))
        place = F.row_number().over(W.partitionBy("_part").orderBy("seq"))
        named = good.join(F.broadcast(before), "_part").withColumn("node_id", (F.lit(first) + F.col("_before") + place).cast("long"))
        named = cut(named.drop("_part", "_before"))
        self._publish(now.unionByName(named.select("node_id", "embedding", F.col("metadata").cast(METADATA).alias("metadata"))))
        return named.select("seq", "node_id", "error").unionByName(done.filter("error is not null").select("seq", F.lit(None).cast("long").alias("node_id"), "error"))

    def vacuum(self, ids: DataFrame) -> int:
        """Deletes nodes (one column) from vectors, metadata and so from graphs built later. Gives how many there were."""
        gone, now = ids.select(F.col(ids.columns[0]).alias("node_id")).distinct(), self.snapshot()
        n = now.join(gone, "node_id", "left_semi").count()
        if n:
            self._publish(now.join(gone, "node_id", "left_anti"))
        return n

    def get(self, node_id: int) -> dict:
        row = self.snapshot().filter(F.col("node_id") == node_id).first()
        if row is None:
            raise NodeNotFound(f"no node {node_id}")
        return row.asDict(recursive=True)

    def search(self, query: Sequence[float] | DataFrame, config: SearchConfig | None = None) -> DataFrame:
        """(qid, id, rank, score, d_total, metadata) for one vector, or for queries (qid, q)."""
        config = config or SearchConfig()
        if not isinstance(query, DataFrame):
            if len(query) != self.dimensions:
                raise DimensionMismatch(self.dimensions, len(query))
            query = self.spark.createDataFrame([(-1, [float(x) for x in query])], "qid long, q array<float>")
        now = self.snapshot()
        stats = self.graph(config.hops)[1] if config.enable_reranking and self.versions() else None
        return retrieve(query, self._vectors(), config, stats).join(now.select(F.col("node_id").alias("id"), "metadata"), "id")

    def why(self, query: Sequence[float], node_id: int, config: SearchConfig | None = None) -> dict:
        """How a search judges a node: its squared distance, score, place among all nodes by distance, neighbourhood and d_total."""
        config, node = config or SearchConfig(), self.get(node_id)
        if len(query) != self.dimensions:
            raise DimensionMismatch(self.dimensions, len(query))
        q = self.spark.createDataFrame([(-1, [float(x) for x in query])], "qid long, q array<float>")
        rows = topk.pairs(q, self._vectors(), V.l2_sq("q", "v"))
        mine = self._vectors().filter(F.col("id") == node_id).crossJoin(F.broadcast(q)).select(V.l2_sq("q", "v").alias("l2"), V.retrieval_score("q", "v", config.score_mode).alias("score")).first()
        nearer = rows.filter((F.col("distance") < mine["l2"]) | ((F.col("distance") == mine["l2"]) & (F.col("id") < node_id))).count()
        ego = self.graph(config.hops)[1].filter(F.col("ego") == node_id).first()
        d_total = config.alpha * (1 - mine["score"]) + config.beta * math.exp(-ego["beta1"] / max(ego["ne"], 1))
        return {"node_id": node["node_id"], "l2_sq": mine["l2"], "score": mine["score"], "place": nearer + 1, "is_candidate": nearer < config.candidates, "nv": ego["nv"], "ne": ego["ne"], "beta1": ego["beta1"], "d_total": d_total, "metadata": node["metadata"]}

    def __len__(self) -> int:
        return self.snapshot().count()

    def stats(self, true_hubs: bool = False) -> DataFrame:
        """One row: total_nodes, dimensions, memory_usage_bytes, bitplane_coarse_bytes, avg_hub_score, max_hub_score, hub_count. The hub figures are
        fixed placeholders (0.3, 0.8, a tenth of the nodes) unless they are asked for truly."""
        n = len(self)
        m = memory_model(n, self.dimensions)
        if true_hubs and n > 1:
            hubs = graph.hub_scores(self.graph()[0])
            avg, most, many = hubs.agg((F.sum("hub_score") / n).alias("a"), F.max("hub_score"), F.count_if(F.col("hub_score") > 0.5)).first()
        else:
            avg, most, many = (0.3, 0.8, -(-n // 10)) if n else (0.0, 0.0, 0)
        return self.spark.createDataFrame(
            [(n, self.dimensions, m["memory_usage_bytes"], m["bitplane_coarse_bytes"], float(avg), float(most), int(many))],
            "total_nodes long, dimensions int, memory_usage_bytes long, bitplane_coarse_bytes long, avg_hub_score double, max_hub_score double, hub_count long",
        )


def batch_has_errors(results: DataFrame) -> DataFrame:
    """One row: has_errors, error_count."""
    return results.agg(F.coalesce(F.bool_or(F.col("error").isNotNull()), F.lit(False)).alias("has_errors"), F.count_if(F.col("error").isNotNull()).alias("error_count"))


def batch_success_ids(results: DataFrame) -> DataFrame:
    """(seq, node_id) of the items that were stored, for reading in order of seq."""
    return results.filter("error is null").select("seq", "node_id")


def access_predictor(log: DataFrame) -> DataFrame:
    """(prev, next, weight, is_best) from an access log (seq, id): each step from one id to the next raises the pair's weight w to min(0.9 w + 0.1, 1), so
    n steps give 1 - 0.9^n. The log is sorted in parts; a part's first step comes from the last id of the parts before it, of which the driver's plan holds one row each."""
    parts = cut(log.select("seq", "id").repartitionByRange("seq").withColumn("_part", F.spark_partition_id()))
    inner = parts.withColumn("prev", F.lag("id").over(W.partitionBy("_part").orderBy("seq")))
    ends = parts.groupBy("_part").agg(F.min_by("id", "seq").alias("first"), F.max_by("id", "seq").alias("last"))
    across = ends.select(F.lag("last").over(W.orderBy("_part")).alias("prev"), F.col("first").alias("id"))  # a row per part
    steps = inner.select("prev", "id").unionByName(across).filter("prev is not null").groupBy("prev", F.col("id").alias("next")).agg(F.count(F.lit(1)).alias("n"))
    weighed = steps.withColumn("weight", 1 - F.pow(F.lit(0.9), "n"))
    best = F.row_number().over(W.partitionBy("prev").orderBy(F.desc("weight"), "next")) == 1
    return weighed.select("prev", "next", "weight", best.alias("is_best"))
