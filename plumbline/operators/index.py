"""A kept index of a layered graph, vectors and quantised codes.

The index is a folder of versions, each with tables of Parquet files: nodes
(id, level, v, code and its factors), edges (layer, src, dst, dist) and center.
A change writes a new version; readers keep theirs. Searches step through the graph
for all queries at once; which numbers guide them is the mode:

- ``asymmetric``: distances of vectors; the results carry their codes' estimates.
- ``beam``: vectors in the layers above 0, estimates at layer 0, with a wider beam;
  the first of it are rescored by their vectors.
- ``hybrid``: as ``beam``, but a node whose vector is near by and whose estimate is
  off by more than a factor of 2 counts by its true distance.
- ``exact``: a scan of all vectors, without the graph.

After compact(), nodes of layer 0 have no vectors, and every search but ``hybrid``
is a ``beam`` one, as only codes are left there.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import graph, rabitq, topk
from plumbline.operators.store import combined_memory
from plumbline.plans.cutting import cut
from plumbline.plans.tables import Versions
from plumbline.schema import DimensionMismatch, IndexConfig, NodeNotFound

MODES = ("asymmetric", "beam", "hybrid", "exact")
#: Widening of the beam that estimates guide, at least.
OVERSAMPLE = 1.5


class CodeSteps(graph.Steps):
    """Steps by estimates from codes; verified: where a node has a vector, its distance counts where it differs from the estimate by more than a factor of 2."""

    queries = ("y", "sqr_y", "q")

    def __init__(self, metric: str, bits: int, dim: int, verified: bool):
        super().__init__(metric)
        self.bits, self.dim, self.verified = bits, dim, verified
        self.nodes = ("code", "sqr_norm", "norm", "x0", *(("full", "known") if verified else ()))

    def size(self) -> Column:
        return F.size("code") + 24 + (4 * F.size("full") if self.verified else 0)

    def load(self, columns: list[pa.ChunkedArray]) -> tuple:
        sqr, norm, x0 = (np.asarray(c.combine_chunks()) for c in columns[1:4])
        held = graph.matrix(columns[0]).astype(np.uint8), sqr, 2 * norm / (x0 * math.sqrt(self.dim))
        return (*held, graph.matrix(columns[4]), np.asarray(columns[5].combine_chunks())) if self.verified else held

    def far(self, held: tuple, at: np.ndarray, query: tuple) -> np.ndarray:
        y, sqr_y, q = query
        score = np.maximum(held[1][at] + sqr_y - held[2][at] * (rabitq.values_of(held[0][at].astype(float), self.bits) @ y), 0.0)
        if not self.verified:
            return score
        precise = super().far(held[3:], at, (q,))
        return np.where((held[4][at] > 0) & ((precise > 2 * score) | (2 * precise < score)), precise, score)


class CombinedIndex:
    def __init__(self, spark: SparkSession, folder: str, config: IndexConfig | None = None):
        self.spark, self.config = spark, config or IndexConfig()
        self.kept = Versions(spark, folder)
        self.rotation = rabitq.rotation(self.config.dimensions, self.config.seed)

    # ---- tables
    def nodes(self) -> DataFrame:
        """(id, level, v, code, sqr_norm, norm, x0, error_bound) of the latest version; v is null where compact() has dropped it."""
        return self.kept.read("nodes", "id long, level int, v array<float>, code array<int>, sqr_norm double, norm double, x0 double, error_bound double")

    def edges(self) -> DataFrame:
        """(layer, src, dst, dist) of the latest version."""
        return self.kept.read("edges", "layer int, src long, dst long, dist double")

    def center(self) -> DataFrame:
        return self.kept.read("center", "c array<double>")

    def __len__(self) -> int:
        return self.nodes().count()

    def is_empty(self) -> bool:
        return not self.kept.known() or not self.nodes().limit(1).count()

    def is_compacted(self) -> bool:
        return bool(self.nodes().filter("v is null").limit(1).count())

    def entry_point(self) -> int | None:
        row = graph.entry_point(self.nodes()).first()
        return row["id"] if row else None

    def node(self, node_id: int) -> dict:
        """A node's row: its vector, level and code."""
        row = self.nodes().filter(F.col("id") == node_id).first()
        if row is None:
            raise NodeNotFound(f"no node {node_id}")
        return row.asDict()

    def neighbors(self, node_id: int, layer: int = 0) -> DataFrame:
        """(dst, dist) of a node's edges at a layer, the nearest first."""
        return self.edges().filter((F.col("src") == node_id) & (F.col("layer") == layer)).select("dst", "dist").orderBy("dist", "dst")

    # ---- changes
    def insert(self, vectors: DataFrame) -> int:
        """Links new vectors (id, v) into the graph and codes them. The first batch builds the layers and sets the center. Gives the version. No vector is stored
        if one has another number of dimensions, or if the index is compacted."""
        dim = self.config.dimensions
        wrong = vectors.filter(F.coalesce(F.size("v"), F.lit(-1)) != dim).select(F.size("v").alias("n")).first()
        if wrong:
            raise DimensionMismatch(dim, wrong["n"])
        m, metric = self.config.max_neighbors, self.config.metric
        new = cut(topk.spread(vectors.select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<float>").alias("v"))))
        old = self.nodes()
        if first := self.is_empty():
            center = cut(rabitq.centroid(new))
            edges = graph.layers(new, m, metric)
        else:
            if self.is_compacted():
                raise ValueError("a compacted index takes no more vectors")
            center, before = self.center(), self.edges()
            levels = cut(new.withColumn("level", graph.level(F.col("id"), m)))
            top = max(x.agg(F.max("level")).first()[0] or 0 for x in (levels, old))
            edges = None
            for k in range(top + 1):
                held, mine = old.filter(F.col("level") >= k).select("id", "v"), levels.filter(F.col("level") >= k).select("id", "v")
                part, degree = before.filter(F.col("layer") == k).drop("layer"), m if k == 0 else max(1, m // 2)
                if mine.limit(1).count():
                    if held.limit(2).count() > 1:
                        part = graph.insert(part, held, mine, degree, self.config.ef_construction, metric=metric)
                    else:
                        part = graph.build(held.unionByName(mine), degree, metric)
                part = part.select(F.lit(k).alias("layer"), "src", "dst", "dist")
                edges = part if edges is None else edges.unionByName(part)
        rows = rabitq.encode_rows(new.select("id", graph.level(F.col("id"), m).alias("level"), "v"), center, self.rotation, self.config.rabitq_bits).select(*old.columns)
        return self.kept.write({"nodes": rows if first else old.unionByName(rows), "edges": edges, "center": center})

    def remove(self, ids: DataFrame) -> int:
        """Takes nodes (one column) out of all layers; nodes that lose edges are linked with the lost ones' other in-neighbours. Gives the version."""
        gone = cut(ids.select(F.col(ids.columns[0]).alias("id")).distinct())
        nodes, edges, m = self.nodes(), self.edges(), self.config.max_neighbors
        top, out = nodes.agg(F.max("level")).first()[0] or 0, None
        for k in range(top + 1):
            part = graph.remove_nodes(edges.filter(F.col("layer") == k).drop("layer"), nodes.filter((F.col("level") >= k) & F.col("v").isNotNull()).select("id", "v"), gone, 2 * m if k == 0 else 2 * max(1, m // 2), self.config.metric)
            part = part.select(F.lit(k).alias("layer"), "src", "dst", "dist")
            out = part if out is None else out.unionByName(part)
        return self.kept.write({"nodes": nodes.join(gone, "id", "left_anti"), "edges": out})

    def rebuild_with_centroid(self) -> int:
        """Codes all vectors anew, against their mean. Gives the version."""
        if self.is_compacted():
            raise ValueError("a compacted index has codes only")
        nodes = self.nodes()
        center = cut(rabitq.centroid(nodes.select("id", "v")))
        coded = rabitq.encode_rows(nodes.select("id", "level", "v"), center, self.rotation, self.config.rabitq_bits)
        return self.kept.write({"nodes": coded, "center": center})

    def compact(self) -> int:
        """Drops the vectors of nodes that are at layer 0 only. Gives the bytes freed."""
        nodes = self.nodes()
        freed = nodes.filter("level = 0 and v is not null").count() * 4 * self.config.dimensions
        if freed:
            self.kept.write({"nodes": nodes.withColumn("v", F.when(F.col("level") > 0, F.col("v")))})
        return freed

    # ---- searches
    def search(self, queries: DataFrame, k: int = 10, ef: int | None = None, mode: str | None = None) -> DataFrame:
        """(qid, id, rank, estimated, precise) of queries (qid, q): the k nearest; precise is the squared distance (or cosine distance, by the index's metric),
        null where the vector is dropped. Estimates are of squared distances."""
        mode = mode or self.config.search_mode
        if mode not in MODES:
            raise ValueError(f"unknown mode {mode}")
        dim, metric = self.config.dimensions, topk.METRICS[self.config.metric]
        wrong = queries.filter(F.coalesce(F.size("q"), F.lit(-1)) != dim).select(F.size("q").alias("n")).first()
        if wrong:
            raise DimensionMismatch(dim, wrong["n"])
        nodes = self.nodes()
        coded = cut(rabitq.encode_queries(queries, self.center(), self.rotation, "q"))
        queries = coded.select("qid", "q")
        if self.is_compacted() and mode != "hybrid":
            mode = "beam"
        ef = max(ef or 64, k)
        if mode == "exact":
            near = topk.top_k_bulk(queries, nodes.select("id", "v"), k, self.config.metric, exclude_self=False)
        elif mode == "asymmetric":
            near = graph.search_layers(self.edges(), nodes.select("id", "level", "v"), queries, ef, self.config.metric)
        else:
            near = self._by_estimates(nodes, queries, coded, ef, mode == "hybrid")
            wanted = max(self.config.rerank_top, 5 * k) if self.config.rerank_top else 3 * k
            near = near.filter(F.col("rank") <= wanted)
        near = cut(near.select("qid", "id"))
        rows = near.join(nodes.drop("level"), "id").join(coded, "qid").withColumn("recon", rabitq.reconstructed("code", self.config.rabitq_bits))
        rows = rows.select("qid", "id", F.greatest(rabitq.raw_estimate(dim), F.lit(0.0)).alias("estimated"), F.when(F.col("v").isNotNull(), metric("q", "v")).alias("precise"))
        rows = rows.withColumn("_by", F.coalesce("precise", "estimated"))
        return topk.ranked(rows, k, "_by", "id", "qid").select("qid", "id", "rank", "estimated", "precise")

    def _by_estimates(self, nodes: DataFrame, queries: DataFrame, coded: DataFrame, ef: int, hybrid: bool) -> DataFrame:
        """(qid, id, distance, rank): descent by vectors through the upper layers, which keep theirs, and a beam by estimates at layer 0."""
        edges, metric = self.edges(), topk.METRICS[self.config.metric]
        upper = cut(nodes.filter("level >= 1").select("id", "level", "v"))
        at = graph.descend(edges, upper, queries, self.config.metric) if upper.limit(1).count() else graph.entry_point(nodes)
        rows = nodes.withColumn("recon", rabitq.reconstructed("code", self.config.rabitq_bits)).drop("level")
        if hybrid:  # the vectors that there are, in a column that all nodes have
            none = F.array_repeat(F.lit(0.0).cast("float"), self.config.dimensions)
            rows = rows.withColumn("full", F.coalesce("v", none)).withColumn("known", F.col("v").isNotNull().cast("int"))
        estimate = F.greatest(rabitq.raw_estimate(self.config.dimensions), F.lit(0.0))
        wide = math.ceil(ef * max(self.config.beam_oversample, OVERSAMPLE))
        precise = F.when(F.col("v").isNotNull(), metric("q", "v")) if hybrid else None
        steps = CodeSteps(self.config.metric, self.config.rabitq_bits, self.config.dimensions, hybrid) if self.config.metric in ("l2", "cosine") else None
        return graph.beam_search(edges.filter("layer = 0"), rows, coded, at, wide, estimate, precise, steps)

    def memory(self) -> dict[str, int]:
        """Bytes of graph, vectors, codes and their sum; vectors that compact() has dropped don't count."""
        n, held = self.nodes().agg(F.count(F.lit(1)), F.count("v")).first()
        parts = combined_memory(n, self.config.dimensions, self.config.max_neighbors, self.config.rabitq_bits)
        parts["float"] = held * 4 * self.config.dimensions
        return parts | {"total": parts["graph"] + parts["float"] + parts["codes"]}

    def hot_tier(self) -> DataFrame:
        """One row: nodes, edges and bytes of the layers above 0, which are read first by every search, and a name of this size."""
        nodes, edges = self.nodes().filter("level >= 1").count(), self.edges().filter("layer >= 1").count()
        size = nodes * (4 * self.config.dimensions + 8) + edges * 20
        unit = max(0, min(3, (max(size, 1).bit_length() - 1) // 10))
        shown = f"{size / 1024**unit:.1f} {('B', 'KB', 'MB', 'GB')[unit]}"
        return self.spark.createDataFrame([(nodes, edges, size, shown)], "nodes long, edges long, bytes long, shown string")
