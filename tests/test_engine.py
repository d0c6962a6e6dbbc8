"""Hand-computed values, invariants, recall, sources, store, stream."""

import json
import math
import struct
import subprocess
import sys
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plumbline.functions import matrices as M
from plumbline.functions import vectors as V
from plumbline.operators import bitplane, evaluate, graph, index, rabitq, topk, topology
from plumbline.operators.store import VectorStore, access_predictor, batch_has_errors, batch_success_ids, combined_memory, memory_model
from plumbline.plans import catalogue
from plumbline.schema import CompressionError, DimensionMismatch, IndexConfig, NodeNotFound, SearchConfig
from plumbline.sources import files
from plumbline.streaming import commands


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def vec(*xs):
    return F.array(*(F.lit(float(x)).cast("float") for x in xs))


def test_zero_vectors_by_convention(spark):
    z, a = vec(0, 0), vec(1, 0)
    assert one(spark, V.cosine_distance(z, a)) == 1.0
    assert one(spark, V.cosine_distance(z, a, "graph")) == 2.0
    assert one(spark, V.cosine_distance(z, a, "half")) == 1.0
    assert one(spark, V.cosine_similarity(z, a)) == 0.0
    assert one(spark, V.bulk_cosine_distance(z, a)) == 2.0
    assert one(spark, V.sheaf_cosine(z, a)) == 1.0
    assert one(spark, V.normalize(z)) == [0.0, 0.0]


def test_opposite_vectors(spark):
    a, b = vec(1, 0), vec(-1, 0)
    assert one(spark, V.cosine_distance(a, b)) == 2.0
    assert one(spark, V.cosine_distance(a, b, "half")) == 1.0
    assert one(spark, V.sheaf_cosine(a, b)) == 0.0
    assert one(spark, V.l2_sq(a, b)) == 4.0


def test_sign_bits(spark):
    assert one(spark, V.sign_bits(vec(*[1] * 64))) == [-1]
    assert one(spark, V.sign_bits(vec(*[0] * 64))) == [0]
    assert one(spark, V.sign_bits(vec(*[1] * 96))) == [-1, 2**32 - 1]
    assert one(spark, V.sign_bits(vec(*[1, -1] * 32))) == [0x5555555555555555]
    assert one(spark, V.sign_bits(vec(*[0] * 63, 1))) == [-(2**63)]
    assert one(spark, V.hamming(V.sign_bits(vec(*[1] * 64)), V.sign_bits(vec(*[1, -1] * 32)))) == 32


def test_sql_functions(spark):
    V.register(spark)
    row = spark.sql("select vec_dot(array(1f, 2f), array(3f, 4f)) d, vec_l2_sq(array(1f, 2f), array(3f, 4f)) l, vec_cosine_distance(array(1f, 0f), array(0f, 1f)) c, vec_hamming(array(3L), array(5L)) h").first()
    assert (row["d"], row["l"], row["c"], row["h"]) == (11.0, 8.0, 1.0, 2)


def test_hadamard_and_rotation():
    assert rabitq.hadamard(4)[:, 0].tolist() == [1, 1, 1, 1]
    assert (rabitq.hadamard(4) @ np.ones(4)).tolist() == [4, 0, 0, 0]
    m = np.array(rabitq.rotation(64))
    assert np.allclose(m @ m.T, np.eye(64))
    with pytest.raises(CompressionError):
        IndexConfig(rabitq_bits=2)


def test_coarse_and_partial(spark):
    assert one(spark, bitplane.coarse(vec(1.0, 2.5, -3.14, 0.0, 100.0))) == [1.0, 2.0, -2.0, 0.0, 64.0]
    values = [1.5, -2.75, 100.3, 0.0]
    assert np.allclose(one(spark, bitplane.partial(vec(*values), 23)), np.float32(values))
    errors = [max(abs(a - b) for a, b in zip(one(spark, bitplane.partial(vec(*values), n, msb=True)), values, strict=True)) for n in (0, 4, 8, 16, 23)]
    assert errors == sorted(errors, reverse=True)
    assert bitplane.sizes(256)["coarse"] == 288 and bitplane.sizes(256)["total"] == 1024


def test_planes_match_expressions(spark):
    df = spark.createDataFrame([(0, [1.0, 2.5, -3.14, 100.0])], "id long, v array<float>")
    planes = bitplane.decompose(df)
    for n, msb in ((0, False), (8, False), (8, True), (23, False)):
        a = bitplane.reconstruct(planes, 4, n, msb).first()["v"]
        assert a == pytest.approx(df.select(bitplane.partial("v", n, msb).alias("x")).first()["x"], rel=1e-7)


EDGES = "src long, dst long, dist double"


def both_ways(*pairs):
    return [(a, b, 0.1 * abs(a - b)) for x, y in pairs for a, b in ((x, y), (y, x))]


@pytest.mark.parametrize(
    ("pairs", "beta1"), [([(0, 1), (1, 2)], 0), ([(0, 1), (1, 2), (0, 2)], 1), ([(0, 1), (1, 2), (0, 2), (1, 3), (2, 3)], 2), ([(a, b) for a in range(4) for b in range(a)], 3)]
)
def test_betti(spark, pairs, beta1):
    edges = spark.createDataFrame(both_ways(*pairs), EDGES)
    row = topology.ego_stats(edges, spark.range(1), hops=3).first()
    assert (row["beta0"], row["beta1"]) == (1, beta1)


def test_ego_graphs(spark):
    path = spark.createDataFrame(both_ways((0, 1), (1, 2), (2, 3)), EDGES)
    members, inside = topology.ego_pair(path, spark.createDataFrame([(1, 2)], "x long, y long"))
    assert (members.count(), inside.count()) == (4, 3)
    m0, e0 = topology.ego_single(path, spark.range(1), 0)
    assert (m0.count(), e0.count()) == (1, 0)
    m1, e1 = topology.ego_single(path, spark.range(1, 2), 1)
    assert (m1.count(), e1.count()) == (3, 2)


def test_cap_splits_components(spark):
    triangle = spark.createDataFrame(both_ways((0, 1), (1, 2), (0, 2)), EDGES)
    row = topology.ego_stats(triangle, spark.range(1), cap=1).first()
    assert (row["nv"], row["ne"], row["beta0"], row["beta1"]) == (3, 1, 2, 0)


def test_d_total(spark):
    assert one(spark, topology.d_total(F.lit(0.5), F.lit(0), F.lit(3), 0.5, 0.5)) == 0.75
    assert one(spark, topology.d_total(F.lit(0.5), F.lit(1), F.lit(3), 0.5, 0.5)) == pytest.approx(0.25 + 0.5 * math.exp(-1 / 3))


def test_persistence(spark):
    w = lambda *pairs: [(0, min(p), max(p), 0.1 * abs(p[0] - p[1])) for p in pairs]
    schema = "ego long, u long, w long, dist double"
    triangle = topology.persistence(spark.createDataFrame(w((0, 1), (1, 2), (0, 2)), schema)).collect()
    assert sorted((r["dim"], r["birth"], round(r["death"], 9)) for r in triangle) == [(0, 0.0, 0.1), (0, 0.0, 0.1)]
    square = topology.persistence(spark.createDataFrame(w((0, 1), (1, 2), (2, 3), (0, 3)), schema))
    assert [(r["birth"], r["death"]) for r in square.filter("dim = 1").collect()] == [pytest.approx((0.3, 0.3))]
    score = topology.diagram_stats(square).first()["score"]
    assert 0.5 * 0.5 + 0.5 * math.exp(-score / 4) == pytest.approx(0.713872, abs=1e-6)


def test_sheaf(spark):
    stalks = lambda a, b: spark.createDataFrame([(0, "m", a), (1, "m", b)], "node long, modality string, values array<float>")
    edge = spark.createDataFrame([(0, 1)], "src long, dst long")
    h1 = lambda s: topology.sheaf_h1(topology.sheaf_edges(s, edge)).first()["h1"]
    assert h1(stalks([1.0, 0.0], [1.0, 0.0])) == 0
    assert h1(stalks([1.0, 0.0], [-1.0, 0.0])) == pytest.approx(2.0)
    assert h1(stalks([1.0, 0.5], [1.0, 0.4])) == pytest.approx(0.004149, abs=1e-5)
    missing = topology.sheaf_h1(topology.sheaf_edges(stalks([1.0], [1.0]).filter("node = 0"), edge)).first()
    assert (missing["edge_count"], missing["h1"]) == (0, 0.0)
    maps = spark.createDataFrame([(0, 1, [[0.0, 1.0]], [[1.0, 0.0]])], "src long, dst long, src_map array<array<double>>, dst_map array<array<double>>")
    assert topology.sheaf_edges(stalks([5.0, 2.0], [2.0, 7.0]), edge, maps).first()["obstruction"] == 0


def test_top_k_edges(spark):
    q = spark.createDataFrame([(0, [1.0])], "qid long, q array<float>")
    base = spark.createDataFrame([(i, [float(i % 3)]) for i in range(1, 7)], "id long, v array<float>")
    for search in (topk.top_k, topk.top_k_bulk):
        assert [r["id"] for r in search(q, base, 3).orderBy("rank").collect()] == [1, 4, 2]  # equal distances: the smaller id
        assert search(q, base, 0).count() == 0
        assert search(q, base, 100).count() == 6
        assert search(q, base.limit(0), 3).count() == 0


def test_bulk_passes_agree(spark):
    rng = np.random.default_rng(3)
    base = spark.createDataFrame([(i, rng.normal(size=8).tolist()) for i in range(300)], "id long, v array<float>")
    q = base.filter("id < 40").select(F.col("id").alias("qid"), F.col("v").alias("q"))
    key = lambda df: sorted((r["qid"], r["id"], r["rank"]) for r in df.collect())
    assert key(topk.top_k(q, base, 5)) == key(topk.top_k_bulk(q, base, 5)) == key(topk.top_k_bulk(q, base, 5, broadcast_bytes=900))


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(11)
    rows = [(i, rng.normal(size=16).tolist()) for i in range(600)]
    base = spark.createDataFrame(rows, "id long, v array<float>").repartition(4).cache()
    q = base.filter("id < 30").select(F.col("id").alias("qid"), F.col("v").alias("q"))
    return base, q, topk.top_k_bulk(q, base, 10).cache()


def mean_recall(found, truth):
    return evaluate.recall_at_k(found, truth, 10).agg(F.avg("recall")).first()[0]


def test_code_recall(spark, cloud):
    base, q, truth = cloud
    m = rabitq.rotation(16)
    center = rabitq.centroid(base)
    recall = {}
    for bits in (1, 4):
        codes, qs = rabitq.encode(base, center, m, bits), rabitq.encode_queries(q, center, m)
        recall[bits] = mean_recall(topk.ranked(rabitq.estimates(codes, qs, bits, 16), 10, "estimate", "id", "qid"), truth)
    coded = base.select("id", V.sign_bits("v").alias("v")), q.select("qid", V.sign_bits("q").alias("q"))
    naive = mean_recall(topk.hamming_top_k(coded[1], coded[0], 10), truth)
    assert recall[4] >= recall[1] - 0.05 and recall[1] > naive and recall[4] > 0.6


@pytest.mark.parametrize(("kernel", "column", "missing"), [
    (M.cosine_similarity, V.cosine_similarity, 0.0), (M.cosine_distance(), V.cosine_distance, 1.0), (M.bulk_cosine_distance, V.bulk_cosine_distance, 2.0),
    (M.sheaf_cosine, V.sheaf_cosine, 1.0), (M.retrieval_score(), V.retrieval_score, 0.0), (M.l2_sq, V.l2_sq, None), (M.dot, V.dot, None),
])
def test_kernels_by_matrices(spark, kernel, column, missing):
    """As expressions give them, on odd vectors, too; one partition of rows is dealt to all tasks, as its pairs would be one task's work."""
    odd = [(0, [1.0, 2.0, -3.0]), (1, [0.0, 0.0, 0.0]), (2, None), (3, [1.0, None, 2.0]), (4, [1.0, 2.0]), (5, [3e6, 1.0, 2.0]), (6, [3e6, 1.0, 2.5]), (7, [])]
    base = spark.createDataFrame(odd, "id long, v array<float>").coalesce(1)
    q = base.select(F.col("id").alias("qid"), F.col("v").alias("q"))
    common = column is V.sheaf_cosine
    if missing is not None and not common:  # expressions give no defined cosine of different lengths
        q, base = (x.filter(f"{c} is null or size({c}) = 3") for x, c in ((q, "q"), (base, "v")))
    if common:  # a null within a vector isn't a number to compare
        q, base = q.filter("qid <> 3"), base.filter("id <> 3")
    made = topk.pairs_by(q, base, kernel, missing, common, 6)
    assert made.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    rounded = lambda df: {(r["qid"], r["id"]): r["d"] for r in df.collect()}
    got, want = rounded(made.withColumnRenamed("distance", "d")), rounded(topk.pairs(q, base, column("q", "v")).select("qid", "id", (F.round("distance", 6) + 0.0).alias("d")))
    assert got.keys() == want.keys()
    assert all(got[k] == want[k] or got[k] == pytest.approx(want[k], rel=1e-12) for k in want), [(k, got[k], want[k]) for k in want if got[k] != want[k]]


def test_graph_search_recall(spark, cloud):
    base, q, truth = cloud
    edges = graph.build_partitioned(base, 16, parts=4)
    assert edges.groupBy("src").count().agg(F.max("count")).first()[0] <= 32
    hubs = topk.ranked(graph.hub_scores(edges), 4, "in_degree", "node", descending=True).select("node")
    narrow, wide = (mean_recall(graph.beam_search(edges, base, q, hubs, ef), truth) for ef in (10, 64))
    assert wide >= 0.9 and wide >= narrow - 0.05


def test_partitioned_build_links_more_vectors(spark):
    rng = np.random.default_rng(0)
    v = (rng.normal(size=(100, 64))[rng.integers(0, 100, 12_000)] + rng.normal(size=(12_000, 64)) * 0.5).astype(np.float32)
    base = spark.createDataFrame([(i, x) for i, x in enumerate(v.tolist())], "id long, v array<float>").repartition(4).cache()
    q = rng.choice(len(v), 200, replace=False)
    far = (v[q] ** 2).sum(1)[:, None] + (v**2).sum(1)[None] - 2 * v[q] @ v.T
    far[np.arange(len(q)), q] = np.inf
    true = {int(x): set(t.tolist()) for x, t in zip(q, np.argsort(far, axis=1)[:, :16])}
    found = graph.build_partitioned(base, 16, rounds=0).filter(F.col("src").isin(list(true))).collect()
    recall = sum(r["dst"] in true[r["src"]] for r in found) / (16 * len(q))
    assert recall >= 0.95, recall


def test_meetings_are_bounded(spark):
    """A hub that all are linked with makes no pairs of all: what a refinement moves grows with the vectors, not with the square of their degrees."""
    base = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(300)], "id long, v array<float>")
    edges = spark.createDataFrame([(i, 0, float(i * i)) for i in range(1, 300)], EDGES)
    found = graph._met(edges, base, 16).collect()
    assert {(r["src"], r["dst"]) for r in found} >= {(1, 2), (2, 1), (3, 2)}
    assert all(r["dist"] == (r["src"] - r["dst"]) ** 2 for r in found)
    assert len(found) <= (2 * graph.MEET + 1) * graph.TAKE + 2 * 300


@pytest.mark.parametrize("name", ["graph_search", "rerank_pairwise", "d_total_persistence"])
def test_batch_grows_with_the_table(spark, tmp_path, name):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=64).tolist(), "x") for i in range(210)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = catalogue.QUERIES[name](spark, str(tmp_path)).select("qid").distinct().collect()
    assert {r["qid"] for r in got} == {0, 100, 200}


def test_remove_repair(spark):
    edges = spark.createDataFrame([(0, 1, 1.0), (2, 1, 1.0), (1, 0, 1.0), (2, 3, 1.0)], EDGES)
    base = spark.createDataFrame([(i, [float(i)]) for i in range(4)], "id long, v array<float>")
    out = graph.remove_nodes(edges, base, spark.range(1, 2), 2)
    assert sorted((r["src"], r["dst"]) for r in out.collect()) == [(0, 2), (2, 0), (2, 3)]


def test_evaluation(spark):
    truth = spark.createDataFrame([(0, i, i) for i in (1, 2, 3, 4)], "qid long, id long, rank long")
    found = spark.createDataFrame([(0, 9, 1), (0, 3, 2)], "qid long, id long, rank long")
    assert [evaluate.recall_at_k(found, truth, 4, d).first()["recall"] for d in evaluate.DENOMINATORS] == [0.25, 0.25, 0.5]
    assert evaluate.mrr_at_k(found, truth, 4).first()["mrr"] == 0.5
    values = spark.createDataFrame([(float(x),) for x in range(10)], "x double")
    assert [r["value"] for r in evaluate.percentile(values, "x", [0, 50, 99, 100]).orderBy("percent").collect()] == [0, 5, 9, 9]
    assert evaluate.results_table([{"a": 1, "b": 0.5}]).splitlines()[-1] == "| 1 | 0.500 |"


def test_memory_models():
    assert combined_memory(100, 128) == {"graph": 25600, "float": 51200, "codes": 8000, "total": 84800}
    assert memory_model(1000, 128)["bitplane_coarse_bytes"] == 144000 and memory_model(1000, 128)["memory_usage_bytes"] == 997024


def test_vecs_files(spark, tmp_path):
    record = lambda xs, kind: struct.pack("<i", len(xs)) + struct.pack(f"<{len(xs)}{kind}", *xs)
    (tmp_path / "s_base.fvecs").write_bytes(record([1.0, 2.0], "f") + record([3.0, 4.0], "f") + b"\x02\0\0\0\0")
    (tmp_path / "s_query.fvecs").write_bytes(record([1.0, 2.5], "f"))
    (tmp_path / "s_groundtruth.ivecs").write_bytes(record([0, 1], "I"))
    b = files.read_bundle(spark, str(tmp_path), "s")
    assert [tuple(r) for r in b.base.orderBy("id").collect()] == [(0, [1.0, 2.0]), (1, [3.0, 4.0])]
    (tmp_path / "large.fvecs").write_bytes(b"".join(record([i, i + 0.5, -i], "f") for i in range(500)))
    small, ranges = (files.read_vecs(spark, str(tmp_path / "large.fvecs"), range_bytes=n).orderBy("pos").collect() for n in (1 << 20, 1000))
    assert small == ranges and [r["pos"] for r in ranges] == list(range(500)) and ranges[7]["v"] == [7.0, 7.5, -7.0]
    assert [(r["id"], r["rank"]) for r in b.truth.orderBy("rank").collect()] == [(0, 1), (1, 2)]


def test_jsonl_and_literals(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"text": "a", "embedding": [1, 2]}\nbroken\n{"text": "b"}\n{"embedding": [1]}\n')
    rows = files.read_jsonl(spark, str(tmp_path / "x.jsonl"), 2).collect()
    assert [(r["embedding"], r["metadata"]["extra"]) for r in rows] == [([1.0, 2.0], {"text": "a"})]
    (tmp_path / "q.json").write_text("[1, 2.5]")
    assert files.vector_literal(spark, str(tmp_path / "q.json")) == files.vector_literal(spark, "[1, 2.5]") == [1.0, 2.5]


def items(spark, n, dim=4, first=0):
    rng = np.random.default_rng(5)
    rows = [(first + i, rng.normal(size=dim).tolist(), (1_700_000_000 + 60 * i, f"s{i % 4}", [f"batch_{i // 25}"], {"text": f"t{i}"})) for i in range(n)]
    return spark.createDataFrame(rows, f"seq long, embedding array<float>, metadata {commands.METADATA}")


def test_store(spark, tmp_path):
    s = VectorStore(spark, str(tmp_path / "store"), 4)
    assert len(s) == 0
    done = s.ingest(items(spark, 40).unionByName(spark.createDataFrame([(99, [1.0], None)], items(spark, 1).schema)))
    assert sorted(r["node_id"] for r in done.filter("error is null").collect()) == list(range(40))
    assert sorted(tuple(r) for r in batch_success_ids(done).collect()) == [(i, i) for i in range(40)]
    row = batch_has_errors(done).first()
    assert (row["has_errors"], row["error_count"]) == (True, 1)
    assert all(r["seq"] == r["node_id"] for r in done.filter("error is null").collect())
    found = s.search(s.get(7)["embedding"], SearchConfig(5)).orderBy("rank").collect()
    assert found[0]["id"] == 7 and [r["score"] for r in found] == sorted((r["score"] for r in found), reverse=True)
    assert s.vacuum(spark.range(0, 10)) == 10 and s.vacuum(spark.range(0, 10)) == 0 and len(s) == 30
    assert all(r["id"] >= 10 for r in s.search([0.0] * 4, SearchConfig(20)).collect())
    assert s.versions() == [1, 2] and s.snapshot(1).count() == 40
    assert s.cache_stats().first()["misses"] == 70 - s.cache_stats().first()["hits"]
    assert s.ingest(items(spark, 1)).first()["node_id"] == 40
    assert s.stats().first()["total_nodes"] == 31
    with pytest.raises(DimensionMismatch):
        s.search([1.0])
    with pytest.raises(NodeNotFound):
        s.get(3)
    for bad in ({"limit": 0}, {"alpha": 1.5}):
        with pytest.raises(ValueError):
            SearchConfig(**bad)
    assert SearchConfig(5, rerank_k=0).candidates == 5 and SearchConfig(5, degraded=True, rerank_k=16).candidates == 8


def test_kept_graph_follows_the_store(spark, tmp_path):
    """Edges and statistics that are taken over equal those made anew."""
    vector = lambda i: (np.random.default_rng(i).normal(size=4) + (100 if i < 30 else 0)).tolist()
    rows = lambda n, first: spark.createDataFrame([(first + i, vector(first + i), None) for i in range(n)], items(spark, 1).schema)
    s = VectorStore(spark, str(tmp_path / "store"), 4, degree=5)
    s.ingest(rows(60, 0))
    s.graph()
    s.ingest(rows(25, 60))
    s.vacuum(spark.range(40, 52))
    edges, stats = s.graph()
    made = graph.knn_graph(s._vectors(), 5)
    show = lambda df, *by: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.select(*by).collect())
    assert show(edges, "src", "dst", "dist", "rank") == show(made, "src", "dst", "dist", "rank")
    assert show(stats, "ego", "nv", "ne", "beta1") == show(topology.ego_stats(made, s._vectors().select("id")), "ego", "nv", "ne", "beta1")
    assert s.cache_stats().first()["hits"] >= 30  # the far cluster's
    found = s.search([0.1] * 4, SearchConfig(3)).orderBy("rank").collect()
    told = s.why([0.1] * 4, found[0]["id"])
    assert told["score"] == pytest.approx(found[0]["score"]) and told["d_total"] == pytest.approx(found[0]["d_total"]) and told["is_candidate"]
    s.invalidate()
    assert s.cache_stats().first()["hit_rate"] == 0 and show(s.graph()[0], "src", "dst") == show(made, "src", "dst")


def test_bit_plane_store(spark, tmp_path):
    s = bitplane.BitPlaneStore(spark, str(tmp_path / "planes"), 3)
    done = s.insert(spark.createDataFrame([(1, [1.0, 2.5, -3.25]), (2, [0.0, 100.0, 7.0]), (3, [1.0])], "id long, v array<float>"))
    assert {r["id"]: r["error"] for r in done.collect()} == {1: None, 2: None, 3: "expected 3 dimensions, got 1"}
    assert {r["id"]: r["v"] for r in s.read().collect()} == {1: [1.0, 2.5, -3.25], 2: [0.0, 100.0, 7.0]}
    assert {r["id"]: r["v"] for r in s.read(0).collect()} == {1: [1.0, 2.0, -2.0], 2: [0.0, 64.0, 4.0]}
    assert {r["id"]: r["deleted"] for r in s.delete(spark.range(2, 4)).collect()} == {2: True, 3: False}
    assert [r["id"] for r in s.read(0).collect()] == [1]
    s.insert(spark.createDataFrame([(1, [4.0, 4.0, 4.0])], "id long, v array<float>"))
    assert [r["v"] for r in s.read().collect()] == [[4.0, 4.0, 4.0]]


def test_scan_takes_any_tile_and_all_ties():
    rng = np.random.default_rng(1)
    for metric in ("l2", "cosine"):
        v, ids, how = rng.integers(0, 3, (4000, 4)).astype(np.float32), rng.permutation(4000).astype(np.int64), topk.Distances(metric)
        batches = [pa.RecordBatch.from_arrays([pa.array(ids[i : i + 1500]), pa.array(list(v[i : i + 1500]), pa.list_(pa.float32()))], names=["id", "v"]) for i in range(0, 4000, 1500)]
        q, qids = v[:40].astype(float), ids[:40]
        found = [topk.scan((qids, q), iter(batches), 10, how, True, tile) for tile in (300, topk.TILE)]
        assert all((a == b).all() for a, b in zip(*found, strict=True))
        for k in range(40):
            far = how.exact(q, (v.astype(float), None), np.full(4000, k), np.arange(4000))
            far[ids == qids[k]] = np.inf
            assert (ids[np.lexsort((ids, far))[:10]] == found[0][2][found[0][0] == k]).all()


def test_scan_of_many_queries_is_bounded():
    """200,000 queries in a task against 5,000 rows, in less than a GB."""
    code = """
import numpy as np, pyarrow as pa, resource
from plumbline.operators import topk
rng = np.random.default_rng(0)
v = rng.normal(size=(1500, 8)).astype(np.float32)
batch = pa.RecordBatch.from_arrays([pa.array(np.arange(1500)), pa.array(list(v), pa.list_(pa.float32()))], names=["id", "v"])
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
at, d, ids = topk.scan((np.arange(200_000) + 10_000, rng.normal(size=(200_000, 8))), iter([batch]), 5, topk.Distances("l2"), True, topk.TILE)
assert len(at) == 1_000_000
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before)
"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=Path(__file__).resolve().parents[1], check=True)
    assert int(done.stdout.split()[-1]) < 1_000_000


def test_index_modes_and_changes(spark, tmp_path, cloud):
    base, q = cloud[0].filter("id < 300"), cloud[1].filter("qid < 12")
    some = base.filter("id < 250")
    made = index.CombinedIndex(spark, str(tmp_path / "index"), IndexConfig(dimensions=16, max_neighbors=8))
    made.insert(some)
    truth = topk.top_k_bulk(q, some, 10, exclude_self=False).cache()
    for mode, least in (("exact", 1.0), ("beam", 0.85)):  # the others are in the catalogue's index_recall
        found = made.search(q, 10, 48, mode).cache()
        assert mean_recall(found, truth) >= least, mode
        assert found.filter("rank = 1 and precise > 1e-9").count() == 0  # every query finds itself
    assert made.entry_point() is not None and made.neighbors(0).count() > 0 and made.node(3)["level"] >= 0
    assert made.edges().groupBy("layer", "src").count().filter("(layer = 0 and count > 16) or (layer > 0 and count > 8)").count() == 0
    made.insert(base.filter("id >= 250"))
    assert len(made) == 300 and made.edges().filter("layer = 0 and dst >= 250 and src < 250").count() > 0
    made.remove(spark.range(0, 5))
    assert len(made) == 295 and made.edges().filter("src < 5 or dst < 5").count() == 0
    before = made.node(77)["norm"]
    made.rebuild_with_centroid()
    assert made.node(77)["norm"] != before
    whole, freed = made.memory(), made.compact()
    assert freed == 64 * made.nodes().filter("level = 0").count() and made.memory()["total"] == whole["total"] - freed and made.is_compacted() and made.compact() == 0
    live = q.filter("qid >= 5")
    after = made.search(live, 10, 48)
    assert mean_recall(after, topk.top_k_bulk(live, base.filter("id >= 5"), 10, exclude_self=False)) >= 0.5
    assert made.hot_tier().first()["nodes"] == made.nodes().filter("level > 0").count()
    for wrong in (lambda: made.insert(base), lambda: made.search(live, mode="none"), lambda: made.search(spark.createDataFrame([(1, [1.0])], "qid long, q array<float>"))):
        with pytest.raises((ValueError, DimensionMismatch)):
            wrong()


def test_command_stream(spark, tmp_path):
    rng = np.random.default_rng(1)
    v = [rng.normal(size=4).tolist() for _ in range(5)]
    lines = [{"seq": i, "op": "ingest", "embedding": x} for i, x in enumerate(v)]
    lines += [{"seq": 5, "op": "search", "embedding": v[0], "cfg": {"limit": 2}}, {"seq": 6, "op": "vacuum", "node_id": 0}, {"seq": 7, "op": "search", "embedding": v[0], "cfg": {"limit": 2}}, {"seq": 8, "op": "search", "embedding": [1.0]}]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(map(json.dumps, lines)))
    s = VectorStore(spark, str(tmp_path / "store"), 4)
    run = lambda: commands.finish(commands.start(spark, str(tmp_path / "in"), s, str(tmp_path / "out"), str(tmp_path / "ck")))
    assert not run()
    replies = commands.read_replies(spark, str(tmp_path / "out"))
    first = {r["seq"]: r["node_id"] for r in replies.filter("op = 'search' and rank = 1").collect()}
    assert first[5] == 0 and first[7] != 0
    assert "expected 4" in replies.filter("seq = 8").first()["error"] and len(s) == 4
    more = [{"seq": 9, "op": "ingest", "embedding": v[1]}, {"seq": 10, "op": "shutdown"}, {"seq": 11, "op": "ingest", "embedding": v[2]}]
    (tmp_path / "in" / "b.json").write_text("\n".join(map(json.dumps, more)))
    assert run() and len(s) == 5  # a shutdown ends the stream; what comes behind it isn't applied
    (tmp_path / "in" / "c.json").write_text(json.dumps({"seq": 12, "op": "stats"}))
    assert run()  # and it stays shut
    commands.restart(spark, str(tmp_path / "out"))
    assert not run() and len(s) == 5
    replies = commands.read_replies(spark, str(tmp_path / "out"))
    assert replies.filter("seq = 9").count() == 1 and replies.filter("seq in (10, 11)").count() == 0 and replies.filter("seq = 12").first()["node_id"] == 5


def test_a_replayed_batch_changes_nothing(spark, tmp_path, monkeypatch):
    """A batch that dies between its steps, or inside of one, is tried again."""
    rows = [(i, op, i, [float(i), 1.0] if op != "vacuum" else None, None, None) for i, op in enumerate(["ingest", "ingest", "vacuum", "ingest"])]
    batch = spark.createDataFrame(rows, commands.SCHEMA)
    s = VectorStore(spark, str(tmp_path / "store"), 2)
    s.ingest(spark.createDataFrame([(i, [0.0, float(i)], None) for i in range(4)], items(spark, 1).schema))
    whole, calls = commands._apply, []

    def dies(*args):
        calls.append(args[1])
        out = whole(*args)
        if len(calls) in (1, 3):
            raise OSError("lost")
        return out

    monkeypatch.setattr(commands, "_apply", dies)
    for _ in range(2):
        with pytest.raises(OSError):
            commands.apply_batch(s, batch, str(tmp_path / "out"), 7)
    for _ in range(2):
        assert not commands.apply_batch(s, batch, str(tmp_path / "out"), 7)
    assert calls == ["ingest", "ingest", "vacuum", "vacuum", "ingest"]
    got = sorted((r["seq"], r["op"], r["node_id"]) for r in commands.read_replies(spark, str(tmp_path / "out")).collect())
    assert got == [(0, "ingest", 4), (1, "ingest", 5), (2, "vacuum", 2), (3, "ingest", 6)]
    assert sorted(r["node_id"] for r in s.snapshot().collect()) == [0, 1, 3, 4, 5, 6]


def test_access_predictor(spark):
    log = spark.createDataFrame([(0, 1), (1, 2), (2, 1), (3, 2), (4, 1), (5, 3)], "seq long, id long")
    best = {r["prev"]: (r["next"], round(r["weight"], 6)) for r in access_predictor(log).filter("is_best").collect()}
    assert best == {1: (2, 0.19), 2: (1, 0.19)}


def test_many_queries_keep_their_rows(spark, monkeypatch):
    """With as many queries as rows, a task compares its own queries with all rows, so nothing is shuffled; the results are those of the other way, ties, odd sizes and several passes, too."""
    rng = np.random.default_rng(2)
    v = np.concatenate([rng.integers(0, 3, (300, 4)), rng.normal(size=(200, 4)) * 1e4 + 1e6, rng.normal(size=(20, 4)) * 1e-12]).astype(np.float32)
    base = spark.createDataFrame([(i, x) for i, x in enumerate(v.tolist())], "id long, v array<float>").repartition(5)
    q = base.select(F.col("id").alias("qid"), F.col("v").alias("q"))
    rows = lambda df: sorted(map(tuple, df.select("qid", "id", "distance", "rank").collect()))
    want = rows(topk.top_k_by(q, base, 6, topk.Distances("l2")))
    monkeypatch.setattr(topk, "MANY", 100)
    made = topk.top_k_bulk(q, base, 6)
    assert "Exchange hashpartitioning(qid" not in made._jdf.queryExecution().executedPlan().toString()
    assert rows(made) == want
    monkeypatch.setattr(topk, "BROADCAST_BYTES", 8000)
    assert rows(topk._by_rows(q, base, 6, topk.Distances("l2"), True, topk.TILE)) == want


def test_held_graph_gives_what_joins_give(spark, monkeypatch):
    """Selection and beams by tasks that hold vectors and graph, which move no vectors, against the way of larger tables."""
    rng = np.random.default_rng(3)
    v = rng.normal(size=(150, 6)).astype(np.float32)
    v[140:] = v[:10]
    base = spark.createDataFrame([(3 * i, x) for i, x in enumerate(v.tolist())], "id long, v array<float>").repartition(3).cache()
    near = graph.knn_graph(base, 12).select("src", "dst", "dist").unionByName(spark.createDataFrame([(0, 7, 0.5)], EDGES)).cache()  # 7 has no vector
    q, first = base.filter("id < 30").select(F.col("id").alias("qid"), F.col("v").alias("q")), spark.createDataFrame([(90,), (3,), (7,)], "node long")
    rows = lambda df: sorted(tuple(round(x, 9) for x in r) for r in df.collect())
    made = graph.select_neighbors(near, base, 6)
    assert "Join" not in made._jdf.queryExecution().executedPlan().toString()
    run = lambda: (rows(graph.select_neighbors(near, base, 6)), rows(graph.beam_search(near, base, q, first, 8)), rows(graph.backfill(near, base, 6, metric="cosine")))
    held = run()
    monkeypatch.setattr(graph, "BROADCAST_BYTES", 0)
    assert held == run()


def test_ego_stats_move_members_only(spark):
    """Counts are made where an ego's members meet, without a row for each of their edges, and are those of the groups' edge tables."""
    rng = np.random.default_rng(5)
    edges = spark.createDataFrame([(int(a), int(b), 1.0) for a, b in {(a, b) for a, b in rng.integers(0, 40, (160, 2))}], EDGES).cache()
    egos, show = spark.range(45), lambda df: sorted(map(tuple, df.select("ego", "nv", "ne", "beta0", "beta1", "euler").collect()))
    for hops, cap in ((1, 4), (2, 500)):
        made = topology.ego_stats(edges, egos, hops, cap)
        assert "least(" not in made._jdf.queryExecution().executedPlan().toString()
        members, inside = topology.ego_single(edges, egos, hops)
        assert show(made) == show(topology.betti(members, topology.cap_edges(inside, cap)))


def test_beams_by_codes_that_tasks_hold(spark, monkeypatch):
    """Estimates, and distances where there are vectors, guide a beam in a task as they do by joins."""
    rng = np.random.default_rng(6)
    base = spark.createDataFrame([(i, x) for i, x in enumerate(rng.normal(size=(80, 8)).tolist())], "id long, v array<float>").cache()
    edges, m, center = graph.knn_graph(base, 6).cache(), rabitq.rotation(8), rabitq.centroid(base).cache()
    q = base.filter("id < 5").select(F.col("id").alias("qid"), F.col("v").alias("q"))
    coded = q.join(rabitq.encode_queries(q, center, m), "qid").cache()
    nodes = base.join(rabitq.encode(base, center, m, 4), "id").withColumn("v", F.when(F.col("id") % 3 > 0, F.col("v"))).withColumn("recon", rabitq.reconstructed("code", 4))
    nodes = nodes.withColumn("full", F.coalesce("v", F.array_repeat(F.lit(0.0).cast("float"), 8))).withColumn("known", F.col("v").isNotNull().cast("int")).cache()
    estimate, precise = F.greatest(rabitq.raw_estimate(8), F.lit(0.0)), F.when(F.col("v").isNotNull(), V.l2_sq("q", "v"))
    run = lambda: sorted(tuple(round(x, 9) for x in r) for r in graph.beam_search(edges, nodes, coded, spark.range(70, 72), 5, estimate, precise, index.CodeSteps("l2", 4, 8, True)).collect())
    held = run()
    monkeypatch.setattr(graph, "BROADCAST_BYTES", 0)
    assert held == run()


def test_searching_tasks_share_the_queries(spark):
    """Queries that all stand in one partition, as new vectors in a table's last file, are dealt to all tasks."""
    rng = np.random.default_rng(8)
    base = spark.createDataFrame([(i, x) for i, x in enumerate(rng.normal(size=(120, 4)).tolist())], "id long, v array<float>").repartition(6).cache()
    q = base.repartition(1).union(base.limit(0).repartition(5)).select(F.col("id").alias("qid"), F.col("v").alias("q"))
    found = graph._held_beams(graph.knn_graph(base, 6), base, q, spark.range(1), 4, graph.Steps("l2"))
    rows = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(rows) == 480 and max(rows) < 240


def test_repeated_candidates_count_once(spark):
    """Selection takes a pair that comes twice as one candidate, over the border of two batches, too."""
    rng = np.random.default_rng(9)
    base = spark.createDataFrame([(i, x) for i, x in enumerate(rng.normal(size=(60, 5)).tolist())], "id long, v array<float>").cache()
    near = graph.knn_graph(base, 9).select("src", "dst", "dist").cache()
    rows = lambda df: sorted(map(tuple, df.collect()))
    want = rows(graph.select_neighbors(near, base, 5))
    assert rows(graph.select_neighbors(near.union(near), base, 5)) == want
    parts = [tuple(np.array(c) for c in x) for x in (([1, 1, 2], [5, 5, 6]), ([2, 2, 3], [6, 7, 7]), ([], []), ([3], [7]))]
    assert [tuple(map(list, x)) for x in graph._unrepeated(iter(parts))] == [([1, 2], [5, 6]), ([2, 3], [7, 7]), ([], [])]


def test_layers_are_built_at_once(spark, monkeypatch):
    """Tasks that hold all vectors deal and sort the edges of all layers themselves: the JVM sorts none, and the graph is what joins give, with copies and ids far apart."""
    rng = np.random.default_rng(9)
    v = rng.normal(size=(220, 5)).astype(np.float32)
    v[150:170] = v[3]
    base = spark.createDataFrame([(7 * i - 100, x) for i, x in enumerate(v.tolist())], "id long, v array<float>").repartition(3).cache()
    rows = lambda df: sorted(tuple(r) for r in df.select("layer", "src", "dst", "dist").collect())
    plan = graph.layers(base, 3)._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan and "Window" not in plan and "Join" not in plan
    held = {metric: rows(graph.layers(base, 3, metric)) for metric in ("l2", "cosine")}
    assert {r[0] for r in held["l2"]} >= {0, 1, 2}
    monkeypatch.setattr(graph, "held_by_all", lambda vectors: None)
    for metric in held:
        other = rows(graph.layers(base, 3, metric))
        assert [r[:3] for r in held[metric]] == [r[:3] for r in other]
        assert np.allclose([r[3] for r in held[metric]], [r[3] for r in other], rtol=0, atol=1e-12)


def test_rows_are_coded_as_expressions_code_them(spark):
    """encode_rows() gives encode()'s bits, without a join, also for copies of the center, zeros and vectors that hold a null."""
    rng = np.random.default_rng(10)
    v = [*rng.normal(size=(60, 12)).tolist(), [0.0] * 12, [None, *[1.0] * 11], [float("nan")] * 12, [1e30] * 12]
    base = spark.createDataFrame(list(enumerate(v)), "id long, v array<float>").cache()
    center, m = rabitq.centroid(base.filter("id < 60")).cache(), rabitq.rotation(12)
    v0 = spark.createDataFrame([(99, center.first()["c"])], "id long, v array<float>")
    for bits in (1, 4, 7):
        given = base.unionByName(v0).withColumn("level", F.lit(2))
        made = rabitq.encode_rows(given, center, m, bits)
        assert "Join" not in made._jdf.queryExecution().executedPlan().toString()
        want = {r["id"]: r for r in rabitq.encode(given, center, m, bits).collect()}
        for r in made.collect():
            assert r["level"] == 2 and all(repr(r[c]) == repr(want[r["id"]][c]) for c in ("code", "sqr_norm", "norm", "x0", "error_bound")), r


def test_close_places_in_cached_blocks():
    """The blocks, whole and partial, have every place that a plain comparison finds."""
    rng = np.random.default_rng(11)
    for n, m in ((512, 1024), (700, 2100), (3, 5), (513, 8)):
        left, right = (rng.normal(size=(k, 4)).astype(np.float32) for k in (n, m))
        limit = rng.normal(-3, 1, n).astype(np.float32)
        got = topk._under(left, right, limit)
        # a block's product may differ from the whole one's in the last bit
        d = left.astype(float) @ right.T.astype(float) - limit[:, None]
        seen = np.zeros(d.shape, bool)
        seen[got] = True
        assert len(got[0]) == seen.sum() and seen[d < -1e-5].all() and not seen[d > 1e-5].any()


def test_index_compact_needs_no_worker_for_its_row(spark):
    """The one row of figures is a constant of the plan."""
    made = catalogue.QUERIES["index_compact"](spark, "/root/testdata/sf0.001")
    assert "ExistingRDD" not in made._jdf.queryExecution().executedPlan().toString() and made.count() == 1


def test_only_vectors_with_ids_of_their_own_are_held(spark):
    """Repeated and missing ids go the way of joins; whether there are any is seen where the vectors are held, without an exchange."""
    rows = lambda *ids: spark.createDataFrame([(i, [float(k), 1.0]) for k, i in enumerate(ids)], "id long, v array<float>")
    assert graph.held_by_all(rows(5, 3, 5)) is None and graph.held_by_all(rows(5, None)) is None
    assert graph.held_by_all(rows(5, 3, 9)).value[0].tolist() == [3, 5, 9]


def test_compaction_writes_nodes_only(spark, tmp_path, cloud):
    """A change writes the tables that it changes; the graph of a compacted index is the one of the version before."""
    made = index.CombinedIndex(spark, str(tmp_path / "index"), IndexConfig(dimensions=16, max_neighbors=4))
    made.insert(cloud[0].filter("id < 60"))
    before, center = sorted(made.edges().collect()), made.center().first()
    made.compact()
    assert sorted(p.name for p in (tmp_path / "index" / "v2").iterdir() if not p.name.startswith(".")) == ["_DONE", "nodes"]
    assert sorted(made.edges().collect()) == before and made.center().first() == center and made.is_compacted()
