"""Nearest-neighbour graphs as edge tables (src, dst, dist)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions import vectors as V
from plumbline.operators import topk
from plumbline.operators.topk import BROADCAST_BYTES, METRICS, Distances, in_passes, matrix_of, ranked, spread, top_k_bulk, within
from plumbline.plans.cutting import cut, release

ALPHA = 1.2
#: In-neighbours that a removed node offers to its others.
OFFERED = 1024


def knn_graph(vectors: DataFrame, k: int = 16, metric: str = "l2") -> DataFrame:
    """(src, dst, dist, rank): each vector's exact k nearest others. The vectors are taken in passes of a bounded size as queries."""
    queries = vectors.select(F.col("id").alias("qid"), F.col("v").alias("q"))
    return top_k_bulk(queries, vectors, k, metric).select(F.col("qid").alias("src"), F.col("id").alias("dst"), F.col("distance").alias("dist"), "rank")


def knn_changes(edges: DataFrame, before: DataFrame, now: DataFrame, k: int, metric: str = "l2") -> tuple[DataFrame, DataFrame]:
    """The graph (src, dst, dist, rank) of knn_graph for the vectors of now, from that for the vectors before (id, v), and the nodes (id) whose edges are others.
    Only new nodes, and those that have lost an edge, are compared with all; the rest is compared with the new ones alone."""
    added, gone = now.join(before.select("id"), "id", "left_anti"), before.select("id").join(now.select("id"), "id", "left_anti")
    left = edges.select("src", "dst", "dist").join(gone.withColumnRenamed("id", "src"), "src", "left_anti")
    lost = cut(left.join(gone.withColumnRenamed("id", "dst"), "dst", "left_semi").select(F.col("src").alias("id")).distinct())
    anew = cut(now.join(lost, "id", "left_semi").unionByName(added))
    full = top_k_bulk(anew.select(F.col("id").alias("qid"), F.col("v").alias("q")), now, k, metric).select(F.col("qid").alias("src"), F.col("id").alias("dst"), F.col("distance").alias("dist"))
    rest = left.join(anew.select(F.col("id").alias("src")), "src", "left_anti")
    held = now.join(anew.select("id"), "id", "left_anti")
    worst = rest.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.max("dist").alias("far"))
    limits = held.join(worst, "id", "left").select("id", "v", F.when(F.col("n") >= k, F.col("far")).alias("limit"))
    near = within(added.select(F.col("id").alias("qid"), F.col("v").alias("q")), limits, metric).select(F.col("id").alias("src"), F.col("qid").alias("dst"), F.col("distance").alias("dist"))
    near = cut(near)
    new = cut(ranked(full.unionByName(rest).unionByName(near), k, "dist", "dst", "src"))
    return new.select("src", "dst", "dist", "rank"), anew.select("id").unionByName(near.select(F.col("src").alias("id"))).distinct()


def level(node: Column, m: int = 16) -> Column:
    """A node's layer, floor(-ln u / ln m), where u from 0.0001 up to 1 is hashed from its id."""
    u = (F.pmod(node * F.lit(2654435761), F.lit(9999)) + 1) / F.lit(10000.0)
    return F.floor(-F.log(u) / F.lit(math.log(m))).cast("int")


def tier(lv: Column) -> Column:
    return F.when(lv >= 1, "hot").otherwise("cold")


def hub_scores(edges: DataFrame) -> DataFrame:
    """(node, in_degree, hub_score) of nodes that edges lead to: in-degree by the greatest in-degree."""
    degree = edges.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("in_degree"))
    most = degree.agg(F.max("in_degree").alias("most"))  # one row
    return degree.crossJoin(F.broadcast(most)).select("node", "in_degree", (F.col("in_degree") / F.col("most")).alias("hub_score"))


def khop(edges: DataFrame, starts: DataFrame, hops: int, with_start: bool = False) -> DataFrame:
    """(start, node, hop) within ``hops`` out-edges of each start, by the fewest hops; starts: one column."""
    out = edges.select("src", "dst").distinct()
    seen = starts.select(F.col(starts.columns[0]).alias("start")).distinct().withColumn("node", F.col("start")).withColumn("hop", F.lit(0))
    for h in range(1, hops + 1):
        new = seen.filter(F.col("hop") == h - 1).join(out, F.col("node") == F.col("src")).select("start", F.col("dst").alias("node"), F.lit(h).alias("hop"))
        seen = seen.unionByName(new).groupBy("start", "node").agg(F.min("hop").alias("hop"))
    return seen if with_start else seen.filter("node != start")


def remove_nodes(edges: DataFrame, vectors: DataFrame, removed: DataFrame, max_degree: int, metric: str = "l2") -> DataFrame:
    """(src, dst, dist) without the removed nodes (one column id). A node that loses an edge is linked with the lost nodes' other
    in-neighbours, the nearest first, while it has fewer than max_degree edges. A lost node offers its OFFERED nearest in-neighbours, so a hub of many edges
    makes no more than so many pairs for each."""
    gone = removed.select(F.col(removed.columns[0]).alias("gone")).distinct()
    lost = edges.join(gone, F.col("dst") == F.col("gone"), "left_semi").join(gone, F.col("src") == F.col("gone"), "left_anti").select("src", F.col("dst").alias("lost"), "dist")
    left = edges.select("src", "dst", "dist").join(gone, F.col("dst") == F.col("gone"), "left_anti").join(gone, F.col("src") == F.col("gone"), "left_anti")
    place = F.row_number().over(W.partitionBy("lost").orderBy("dist", "src"))
    other = lost.withColumn("place", place).filter(F.col("place") <= OFFERED).select(F.col("src").alias("dst"), "lost")
    lost = lost.select("src", "lost")
    wanted = lost.join(other, "lost").filter("src != dst").select("src", "dst").distinct().join(left.select("src", "dst"), ["src", "dst"], "left_anti")
    degree = left.groupBy("src").agg(F.count(F.lit(1)).alias("degree"))
    placed = scored(wanted, vectors, metric).withColumn("rn", F.row_number().over(W.partitionBy("src").orderBy("dist", "dst"))).join(degree, "src", "left")
    return left.unionByName(placed.filter(F.col("rn") + F.coalesce("degree", F.lit(0)) <= max_degree).select("src", "dst", "dist"))


def _blocks(v: np.ndarray, d: np.ndarray, alpha: float) -> np.ndarray:
    """(nodes, candidates, candidates): whether the second candidate, if chosen, keeps the first out. By products; pairs that these leave in doubt by differences."""
    square = (v * v).sum(2)
    between = v @ (-2 * v).transpose(0, 2, 1)
    between += square[:, :, None]
    between += square[:, None, :]
    off = 4e-12 * square.max(1)[:, None, None]
    less = alpha * between
    less -= d[:, :, None]
    blocks = less < 0
    doubt = np.abs(less, out=less) <= alpha * off
    doubt |= between <= off
    doubt[:, np.arange(d.shape[1]), np.arange(d.shape[1])] = False
    at, other = np.divmod(np.flatnonzero(doubt), d.shape[1])
    node, one = np.divmod(at, d.shape[1])
    for lo in range(0, len(node), step := max(1, HELD // max(1, v.shape[2]))):
        at = node[lo : lo + step], one[lo : lo + step], other[lo : lo + step]
        exact = ((v[at[:2]] - v[at[0], at[2]]) ** 2).sum(1)
        blocks[at] = (exact > 0) & (d[at[:2]] > alpha * exact)
    return blocks


def _spread(v: np.ndarray, d: np.ndarray, m: int, alpha: float, fill: bool, metric: str) -> np.ndarray:
    """Which are chosen of the candidates of several nodes: v (nodes, candidates, numbers), d (nodes, candidates), sorted by distance, NaN where a node has no more.
    One is taken if no chosen one is nearer to it, by alpha, than the node; fill: the nearest of the others fill up to m."""
    n, most = d.shape
    there = ~np.isnan(d)
    if metric == "l2":
        blocks = _blocks(v, d, alpha) if math.isfinite(alpha) else None
    else:
        norm = np.sqrt((v * v).sum(2))
    chosen, taken = np.zeros((n, most), bool), np.zeros(n, int)
    for c in range(most):
        if not math.isfinite(alpha):
            blocked = np.zeros(n, bool)
        elif metric == "l2":
            blocked = (chosen[:, :c] & blocks[:, c, :c]).any(1)
        else:
            product = norm[:, :c] * norm[:, c : c + 1]
            between = np.where(product > 0, 1 - np.clip(np.einsum("ijk,ik->ij", v[:, :c], v[:, c]) / np.where(product > 0, product, 1), -1, 1), 2.0)
            blocked = (chosen[:, :c] & (between > 0) & (d[:, c : c + 1] > alpha * between)).any(1)
        chosen[:, c] = there[:, c] & ~blocked & (taken < m)
        taken += chosen[:, c]
        if (taken >= m).all():
            break
    if fill:
        rest = there & ~chosen
        chosen |= rest & (np.cumsum(rest, 1) <= (m - taken)[:, None])
    return chosen


#: Numbers of candidates' vectors that a selection holds at once.
HELD = 1_000_000


def _columns(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The columns of batches, of which the last one holds vectors."""
    for batch in batches:
        yield *(np.asarray(c) for c in batch.columns[:-1]), matrix_of(batch.columns[-1], batch.num_rows)


def _whole_groups(parts: Iterator[tuple]) -> Iterator[Iterator[tuple]]:
    """Columns sorted by the first one, the last a matrix, in groups by the first: (places of some groups of one size, as a matrix; the columns)."""

    def some(columns: tuple) -> Iterator[tuple]:
        key, v = columns[0], columns[-1]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        count = np.diff(np.r_[first, len(key)])
        for k in np.unique(count):
            alike, step = first[count == k], max(1, HELD // (int(k) * max(1, v.shape[1], int(k))))
            for lo in range(0, len(alike), step):
                yield alike[lo : lo + step, None] + np.arange(k), columns

    left = None
    for new in parts:
        if not len(new[0]):
            continue
        whole = new if left is None else tuple(np.concatenate(x) for x in zip(left, new, strict=True))
        last = int(np.searchsorted(whole[0], whole[0][-1]))
        if last:
            yield some(tuple(x[:last] for x in whole))
        left = tuple(x[last:] for x in whole)
    if left is not None:
        yield some(left)


def _unrepeated(parts: Iterator[tuple]) -> Iterator[tuple]:
    """Sorted columns (src, dst, ...) without the rows whose pair is that of the row before."""
    last = None
    for new in parts:
        src, dst = new[:2]
        if len(src):
            keep = np.r_[(src[0], dst[0]) != last, (src[1:] != src[:-1]) | (dst[1:] != dst[:-1])]
            last = src[-1], dst[-1]
            yield new if keep.all() else tuple(x[keep] for x in new)


def places(ids: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Where each of some ids is among sorted ones; -1 where it isn't."""
    at = np.minimum(np.searchsorted(ids, of), len(ids) - 1)
    return np.where(ids[at] == of, at, -1)


def held_by_all(vectors: DataFrame) -> Broadcast | None:
    """A broadcast of the sorted ids and the matrix of vectors (id, v), if they are few enough for every task, of one length and with whole ids of their own; else none, and they are joined."""
    n, size, least, most = vectors.select(F.size("v").alias("n")).agg(F.count(F.lit(1)), F.sum("n"), F.min("n"), F.max("n")).first()
    if not n or least != most or least < 1 or 4 * size + 8 * n > BROADCAST_BYTES or vectors.schema["id"].dataType.simpleString() not in ("int", "bigint"):
        return None
    table = vectors.select("id", "v").toArrow().combine_chunks()
    flat = table.column(1).combine_chunks()
    if flat.null_count or flat.flatten().null_count or table.column(0).null_count:
        return None
    ids = np.asarray(table.column(0).combine_chunks())
    order = np.argsort(ids)
    if (np.diff(ids[order]) == 0).any():
        return None
    return vectors.sparkSession.sparkContext.broadcast((ids[order], matrix(table.column(1))[order]))


def scored(pairs: DataFrame, vectors: DataFrame, metric: str = "l2") -> DataFrame:
    """(src, dst, dist) of pairs (src, dst) of vectors (id, v). Vectors are moved only where not every task can hold all."""
    shared = held_by_all(vectors) if metric in ("l2", "cosine") else None
    if shared is None:
        v = vectors.select("id", "v")
        return pairs.join(v.withColumnsRenamed({"id": "src", "v": "q"}), "src").join(v.withColumnRenamed("id", "dst"), "dst").select("src", "dst", METRICS[metric]("q", "v").alias("dist"))
    kinds, how = {f.name: f.dataType.simpleString() for f in pairs.schema}, Distances(metric)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, v = shared.value
        for batch in batches:
            src, dst = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            a, b = places(ids, src), places(ids, dst)
            keep = (a >= 0) & (b >= 0)
            src, dst, a, b = src[keep], dst[keep], a[keep], b[keep]
            if metric == "l2":  # the same sums as exact() has
                dist = np.empty(len(src))
                for lo in range(0, len(src), 2048):
                    off = v[a[lo : lo + 2048]].astype(float)
                    off -= v[b[lo : lo + 2048]]
                    off *= off
                    dist[lo : lo + 2048] = off.sum(1)
            else:
                at = np.arange(len(src))
                dist = how.exact(v[a].astype(float), (v[b].astype(float),), at, at)
            yield pa.RecordBatch.from_arrays([pa.array(src), pa.array(dst), pa.array(dist)], names=["src", "dst", "dist"])

    return pairs.select("src", "dst").mapInArrow(run, f"src {kinds['src']}, dst {kinds['dst']}, dist double")


def select_neighbors(candidates: DataFrame, vectors: DataFrame, m: int, alpha: float = ALPHA, fill: bool = True, metric: str = "l2", held: tuple | None = None) -> DataFrame:
    """(src, dst, dist): diverse neighbours of each src from its candidates (src, dst, dist), of which repeated rows count once. Candidates are sorted by src, and a task takes those of many src at once;
    vectors are moved with them only where not every task can hold all. held: what held_by_all() has given for these vectors, in a tuple, if it is known."""
    rows, shared = candidates.select("src", "dst", "dist"), held_by_all(vectors) if held is None else held[0]
    if shared is None:
        rows = rows.join(vectors.select(F.col("id").alias("dst"), "v"), "dst").select("src", "dst", "dist", "v")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def columns(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        ids, v = shared.value
        for src, dst, dist in _unrepeated(tuple(np.asarray(c) for c in batch.columns) for batch in batches):
            at = places(ids, dst)
            keep = at >= 0
            yield src[keep], dst[keep], dist[keep], v[at[keep]].astype(float)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for groups in _whole_groups(_unrepeated(_columns(batches)) if shared is None else columns(batches)):
            for at, (src, dst, dist, v) in groups:
                at = at[_spread(v[at], dist[at], m, alpha, fill, metric)]
                yield pa.RecordBatch.from_arrays([pa.array(src[at]), pa.array(dst[at]), pa.array(dist[at])], names=["src", "dst", "dist"])

    by_src = rows.repartition("src").sortWithinPartitions("src", "dist", "dst")
    return by_src.mapInArrow(run, f"src {kinds['src']}, dst {kinds['dst']}, dist double")


def backfill(edges: DataFrame, vectors: DataFrame, m: int, alpha: float = ALPHA, metric: str = "l2") -> DataFrame:
    """(src, dst, dist): every node's neighbours selected anew from its neighbours and theirs."""
    e = edges.select("src", "dst").distinct()
    two = e.join(e.select(F.col("src").alias("dst"), F.col("dst").alias("far")), "dst").select("src", F.col("far").alias("dst"))
    wanted = e.unionByName(two).filter("src != dst").distinct()
    return select_neighbors(scored(wanted, vectors, metric), vectors, m, alpha, True, metric)


#: Rows of a block of the partitioned build, and how many of the block before it takes, too.
BLOCK, OVERLAP = 2048, 256
#: Rounds of refinement go on while more than this share of the edges is new, but end in any case, as equal distances may swap for ever.
NEW_SHARE, MOST_ROUNDS = 0.02, 12
#: At most so many vectors are gathered to place a tree's cuts; where they stand moves the blocks' borders only.
TREE_SAMPLE = 65_536


def _cuts(sample: np.ndarray, planes: np.ndarray) -> list[list[float]]:
    """A tree's cuts by level: the median, along the level's plane, of the sample's vectors in each cell of the level above."""
    cell, out = np.zeros(len(sample), int), []
    for level, plane in enumerate(planes):
        key = sample @ plane
        middle = [float(np.median(key[inside])) if (inside := cell == c).any() else 0.0 for c in range(2**level)]
        out.append(middle)
        cell = 2 * cell + (key > np.array(middle)[cell])
    return out


def _linked_locally(vectors: DataFrame, planes: np.ndarray, cuts: list[list[float]], plane: np.ndarray, parts: int, m: int, block: int = BLOCK, overlap: int = OVERLAP) -> DataFrame:
    """(src, dst, dist): each vector's nearest among those in its cell of the tree and near it along a projection. Vectors are range-partitioned and sorted by
    both; a task takes them in overlapping blocks of bounded size."""
    import pandas as pd  # here, as workers of the other ways would load it for nothing

    def place(frames):
        for pdf in frames:
            x = np.array(pdf["v"].to_list(), float).reshape(len(pdf), len(plane))
            cell = np.zeros(len(pdf), int)
            for level_plane, middle in zip(planes, cuts, strict=True):
                cell = 2 * cell + (x @ level_plane > np.array(middle)[cell])
            yield pdf.assign(cell=cell, key=x @ plane)

    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema}
    placed = vectors.select("id", "v").mapInPandas(place, f"id {kinds['id']}, v {kinds['v']}, cell long, key double")
    placed = placed.repartitionByRange(parts, "cell", "key", "id").sortWithinPartitions("cell", "key", "id")

    def run(frames):
        carried = None
        for whole in frames:
            for lo in range(0, len(whole), block):
                pdf = whole.iloc[lo : lo + block]
                joined = pdf if carried is None else pd.concat([carried, pdf])
                v, ids = np.stack(joined["v"].to_list()).astype(float), joined["id"].to_numpy()
                x = (v - v.mean(0)).astype(np.float32)  # single precision chooses; distances are exact
                near = (x * x).sum(1)[:, None] + (x * x).sum(1)[None] - 2 * x @ x.T
                np.fill_diagonal(near, np.inf)
                take = min(m, len(ids) - 1)
                if take > 0:
                    at = np.argpartition(near, take - 1, axis=1)[:, :take]
                    yield pd.DataFrame({"src": np.repeat(ids, take), "dst": ids[at].ravel(), "dist": ((v[:, None, :] - v[at]) ** 2).sum(2).ravel()})
                carried = pdf.iloc[-overlap:]

    kind = vectors.schema["id"].dataType.simpleString()
    return placed.select("id", "v").mapInPandas(run, f"src {kind}, dst {kind}, dist double")


#: A vector offers so many of its neighbours, and of those whose neighbour it is, to each other, and each of them takes up to so many.
MEET, TAKE = 16, 8


def _nearest(edges: DataFrame, most: int) -> DataFrame:
    """The edges (src, dst, dist) without repetitions, each src's nearest; one exchange by src serves all steps."""
    one = edges.repartition("src").groupBy("src", "dst").agg(F.min("dist").alias("dist"))
    return one.withColumn("rn", F.row_number().over(W.partitionBy("src").orderBy("dist", "dst"))).filter(F.col("rn") <= most).drop("rn")


def _reverse(edges: DataFrame, most: int) -> DataFrame:
    """(src, dst, dist): of the edges turned round, each src's nearest."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "dist")
    return back.withColumn("rn", F.row_number().over(W.partitionBy("src").orderBy("dist", "dst"))).filter(F.col("rn") <= most).drop("rn")


def _met(edges: DataFrame, vectors: DataFrame, m: int) -> DataFrame:
    """(src, dst, dist): vectors that meet at a common neighbour and are nearer to each other than src's m-th neighbour. A meeting holds 2 * MEET + 1 vectors at
    most, and only these are moved, not the pairs of them."""
    rank = F.row_number().over(W.partitionBy("src").orderBy("dist", "dst"))
    placed = edges.withColumn("rn", rank)
    limit = placed.groupBy(F.col("src").alias("id")).agg(F.max(F.when(F.col("rn") <= m, F.col("dist"))).alias("far"), F.count(F.lit(1)).alias("n"))
    known = vectors.select("id", "v").join(limit, "id", "left").select("id", F.when(F.col("n") >= m, F.col("far")).otherwise(F.lit(float("inf"))).alias("far"), "v")
    near = placed.filter(F.col("rn") <= MEET).select("src", "dst", "dist")
    at = near.unionByName(_reverse(near, MEET)).select(F.col("src").alias("at"), F.col("dst").alias("id")).unionByName(vectors.select(F.col("id").alias("at"), "id")).distinct()
    kind = vectors.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for groups in _whole_groups(_columns(batches)):
            for at, (_, ids, far, v) in groups:
                if (k := at.shape[1]) < 2:
                    continue
                x = v[at]
                square = (x * x).sum(2)
                d = square[:, :, None] + square[:, None, :] - 2 * x @ x.transpose(0, 2, 1)
                d[:, np.arange(k), np.arange(k)] = np.inf
                d[d > far[at][:, :, None] * (1 + 1e-9)] = np.inf
                best = np.argpartition(d, min(TAKE, k - 1) - 1, axis=2)[:, :, : min(TAKE, k - 1)]
                g, i, j = np.nonzero(np.isfinite(np.take_along_axis(d, best, 2)))
                src, dst = at[g, i], at[g, best[g, i, j]]
                yield pa.RecordBatch.from_arrays([pa.array(ids[src]), pa.array(ids[dst]), pa.array(((v[src] - v[dst]) ** 2).sum(1))], names=["src", "dst", "dist"])

    by_place = at.join(known, "id").select("at", "id", "far", "v").repartition("at").sortWithinPartitions("at")
    return by_place.mapInArrow(run, f"src {kind}, dst {kind}, dist double")


def build_partitioned(vectors: DataFrame, m: int = 16, parts: int | None = None, projections: int | None = None, rounds: int | None = None, seed: int = 42, metric: str = "l2") -> DataFrame:
    """(src, dst, dist): an approximate graph with at most 2 * m edges a node, built where the data lie: linked locally in the cells of several random trees, refined
    by rounds in which neighbours of a vector meet, and then selected from each node's 2 * m nearest and the m nearest that it is a neighbour of. No node gathers
    more than its candidates. Unless they are given, the partitions grow with the number of vectors, the trees with its logarithm, and the rounds go on until few
    of the m nearest are new. rounds=0 gives the m nearest as the trees link them, without selection."""
    size = vectors.select(F.max(F.size("v")), F.count(F.lit(1))).first()
    dim, n = size[0] or 1, size[1]
    levels = max(0, math.ceil(math.log2(max(1, n) / (BLOCK // 2))))
    projections = projections or 3 + 2 * levels
    parts = parts or max(8, n // (8 * BLOCK))
    depth = min(levels, 12)  # the driver holds 2 ** depth cuts
    # nearest by cosine are nearest by distance among vectors of length 1
    given, vectors = vectors, vectors.select("id", "v") if metric == "l2" else vectors.select("id", F.transform(V.normalize("v"), lambda x: x.cast("float")).alias("v"))
    sample = np.zeros((0, dim))
    if depth:
        rows = vectors.select("v").orderBy(F.xxhash64("id", F.lit(seed))).limit(TREE_SAMPLE).toArrow()
        sample = np.array(rows.column("v").to_pylist(), float)
    rng, found = np.random.default_rng(seed), None
    for _ in range(projections):
        plane = rng.normal(size=dim)
        planes = rng.normal(size=(depth, dim))
        linked = _linked_locally(vectors, planes, _cuts(sample, planes), plane / np.linalg.norm(plane), parts, m)
        found = linked if found is None else found.unionByName(linked)
    edges = cut(_nearest(found, 2 * m))
    del found, linked
    release(vectors.sparkSession)
    first = lambda df: df.withColumn("rn", F.row_number().over(W.partitionBy("src").orderBy("dist", "dst"))).filter(F.col("rn") <= m).drop("rn")
    if rounds == 0:
        return first(edges)
    for _ in range(rounds or MOST_ROUNDS):
        before, edges = edges, cut(_nearest(edges.unionByName(_met(edges, vectors, m)), 2 * m))
        near = first(edges)
        new = near.join(first(before).select("src", "dst"), ["src", "dst"], "left_anti").count()
        del before
        release(vectors.sparkSession)
        if rounds is None and new <= NEW_SHARE * n * m:
            break
    wanted = edges.unionByName(_reverse(edges, m))
    if metric != "l2":
        wanted = scored(wanted, given, metric)
    chosen = cut(select_neighbors(wanted.groupBy("src", "dst").agg(F.min("dist").alias("dist")), given, 2 * m, metric=metric))
    del edges, wanted, near
    release(given.sparkSession)
    return chosen


class Steps:
    """What a task needs of nodes and queries to step through a graph that it holds: columns of both, and distances. This one goes by vectors."""

    nodes, queries = ("v",), ("q",)

    def __init__(self, metric: str):
        self.how = Distances(metric)

    def size(self) -> Column:
        """Bytes of a node."""
        return 4 * F.size("v")

    def load(self, columns: list[pa.ChunkedArray]) -> tuple:
        return (matrix(columns[0]),)

    def far(self, held: tuple, at: np.ndarray, query: tuple) -> np.ndarray:
        if self.how.metric == "l2":  # the same sums, without a copy of the query for each node
            off = query[0] - held[0][at]
            off *= off
            return off.sum(1)
        v = held[0][at].astype(float)
        return self.how.exact(query[0][None], (v,), np.zeros(len(at), int), np.arange(len(at)))


def matrix(column: pa.ChunkedArray, kind: type | None = None) -> np.ndarray:
    """A column of vectors of one length as a matrix of numbers as they are stored, or of a kind."""
    flat = column.combine_chunks()
    return np.asarray(flat.flatten(), kind).reshape(len(flat), -1)


def _walk(first: np.ndarray, links: tuple, far, ef: int, many: int) -> tuple[np.ndarray, np.ndarray]:
    """Nodes (places) and distances of a beam, as beam_search steps; links: where each node's begin, and to which nodes they lead."""
    begin, to = links
    seen = np.zeros(many, bool)
    seen[first] = True
    at, d, done = first, far(first), np.zeros(len(first), bool)
    while True:
        if len(d) > ef:
            near = np.flatnonzero(d <= np.partition(d, ef - 1)[ef - 1])
            at, d, done = at[near], d[near], done[near]
        order = np.lexsort((at, d))[:ef]
        at, d, done = at[order], d[order], done[order]
        lo, n = begin[at[~done]], begin[at[~done] + 1] - begin[at[~done]]
        if done.all():
            return at, d
        new = to[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())]
        new = np.sort(new[~seen[new]])
        new = new[np.flatnonzero(np.diff(new, prepend=-1))]
        seen[new] = True
        at, d, done = np.concatenate([at, new]), np.concatenate([d, far(new)]), np.concatenate([np.ones(len(at), bool), np.zeros(len(new), bool)])


def _held_beams(edges: DataFrame, nodes: DataFrame, queries: DataFrame, entries: DataFrame, ef: int, steps: Steps) -> DataFrame | None:
    """beam_search() by tasks that hold all of the graph and what its nodes are compared by, each with queries of its own; none if that is too large for a task, or if
    not every node and query has a vector of one length."""
    if any(f.dataType.simpleString() not in ("int", "bigint") for f in (nodes.schema["id"], edges.schema["src"], edges.schema["dst"])):
        return None
    kinds = {f.name: f.dataType.simpleString() for f in queries.schema}
    whole = [F.size(c).alias(c) if nodes.schema[c].dataType.simpleString().startswith("array") else F.lit(1).alias(c) for c in steps.nodes]
    n, own, size, *ends = nodes.select("id", steps.size().alias("b"), *whole).agg(F.count(F.lit(1)), F.countDistinct("id"), F.sum("b"), *(f(c) for c in steps.nodes for f in (F.min, F.max))).first()
    if not n or own != n or any(x is None or x < 1 or x != y for x, y in zip(ends[::2], ends[1::2], strict=True)):
        return None
    if size + 24 * n > BROADCAST_BYTES or 8 * (links := edges.count()) > BROADCAST_BYTES or size + 4 * links > BROADCAST_BYTES:
        return None
    table = nodes.select("id", *steps.nodes).toArrow()
    ids = np.asarray(table.column(0).combine_chunks())
    if any(c.null_count or hasattr(x := c.combine_chunks(), "flatten") and x.flatten().null_count for c in table.columns):
        return None
    order = np.argsort(ids)
    ids, held = ids[order], tuple(x[order] for x in steps.load(table.columns[1:]))
    table = edges.select("src", "dst").toArrow()
    src, dst = (places(ids, np.asarray(c.combine_chunks())) for c in table.columns)
    keep = (src >= 0) & (dst >= 0)
    src, dst = src[keep], dst[keep]
    begin, to = np.searchsorted(np.sort(src), np.arange(n + 1)), dst[np.argsort(src, kind="stable")].astype(np.int32)
    shared = edges.sparkSession.sparkContext.broadcast((ids, held, (begin, to)))
    if "qid" in entries.columns:
        asked = queries.select("qid", *steps.queries).join(entries.groupBy("qid").agg(F.collect_set("id").alias("first")), "qid")
    else:
        asked = queries.select("qid", *steps.queries).crossJoin(F.broadcast(entries.agg(F.collect_set(entries.columns[0]).alias("first"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, held, links = shared.value
        for batch in batches:
            columns = [matrix(pa.chunked_array([c]), float) if kinds[name].startswith("array") else np.asarray(c) for name, c in zip(steps.queries, batch.columns[1:-1], strict=True)]
            qids, out = np.asarray(batch.column(0)), []
            for k, first in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                first = places(ids, np.array(first, np.int64))
                out.append(_walk(np.unique(first[first >= 0]), links, lambda at, query=tuple(c[k] for c in columns): steps.far(held, at, query), ef, len(ids)))
            count = np.array([len(at) for at, _ in out], int)
            rank = np.arange(1, count.sum() + 1) - np.repeat(np.cumsum(count) - count, count)
            columns = np.repeat(qids, count), ids[np.concatenate([at for at, _ in out])], np.concatenate([d for _, d in out]), rank
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["qid", "id", "distance", "rank"])

    kind = nodes.schema["id"].dataType.simpleString()
    return spread(asked, "qid").mapInArrow(run, f"qid {kinds['qid']}, id {kind}, distance double, rank long")


def beam_search(edges: DataFrame, nodes: DataFrame, queries: DataFrame, entries: DataFrame, ef: int, distance: Column | str = "l2", verified: Column | None = None, steps: Steps | None = None) -> DataFrame:
    """(qid, id, distance, rank): the ef nearest nodes reached from the entry points, (id) for all queries or (qid, id). All queries step together: every round,
    the unexpanded nodes among a query's best ef are expanded; the search ends when none is left. distance: a metric over q and v, or a column over those of
    queries (qid, ...) and nodes (id, ...). verified: a better distance, null where there is none; it replaces one that it differs from by more than a factor of 2.
    steps: the same for tasks that hold the whole graph, which is the way of graphs that fit into them; a metric has its own."""
    if steps is None and isinstance(distance, str) and distance in ("l2", "cosine"):
        steps = Steps(distance)
    if steps is not None and (found := _held_beams(edges, nodes, queries, entries, ef, steps)) is not None:
        return cut(found)
    if steps is not None and not isinstance(distance, str):
        nodes = cut(nodes)
    out = cut(edges.groupBy("src").agg(F.collect_set("dst").alias("to")))
    if len(in_passes(queries, 16 * F.size(F.col(queries.columns[1])) + 64)) == 1:
        queries = F.broadcast(queries)
    score = METRICS[distance]("q", "v") if isinstance(distance, str) else distance
    if verified is not None:
        score = F.when((verified > 2 * score) | (2 * verified < score), verified).otherwise(score)
    reach = lambda df: df.join(nodes, "id").join(queries, "qid").select("qid", "id", score.alias("distance"), F.lit(False).alias("done"))
    best = F.row_number().over(W.partitionBy("qid").orderBy("distance", "id"))
    start = entries if "qid" in entries.columns else queries.select("qid").crossJoin(F.broadcast(entries.select(F.col(entries.columns[0]).alias("id"))))
    beam = cut(reach(start.select("qid", "id").distinct()).withColumn("rank", best).filter(F.col("rank") <= ef))
    seen = beam.select("qid", "id")
    while (open_ := beam.filter(~F.col("done"))).limit(1).count():
        reached = open_.join(out, F.col("id") == F.col("src")).select("qid", F.explode("to").alias("id")).distinct().join(seen, ["qid", "id"], "left_anti")
        reached = cut(reached)
        seen = seen.unionByName(reached)  # of checkpointed rounds
        new = reach(reached)
        both = beam.select("qid", "id", "distance", F.lit(True).alias("done")).unionByName(new)
        beam = cut(both.withColumn("rank", best).filter(F.col("rank") <= ef))
        del open_, reached, new, both
        release(edges.sparkSession)
    return beam.select("qid", "id", "distance", F.col("rank").cast("long").alias("rank"))


#: Up to so many vectors, graphs are built from exact neighbours, which costs less there; beyond, where the data lie.
EXACT_ROWS = 200_000


def build(vectors: DataFrame, m: int = 16, metric: str = "l2", alpha: float = ALPHA) -> DataFrame:
    """(src, dst, dist): a diverse graph of at most 2 * m edges a node, selected from its 2 * m nearest and those that it is among the nearest of."""
    if vectors.count() > EXACT_ROWS:
        return build_partitioned(vectors, m, metric=metric)
    if metric in ("l2", "cosine") and (shared := held_by_all(vectors)) is not None:
        return _chosen(cut(_offered(vectors, shared, [m], np.zeros(len(shared.value[0]), np.int8), metric)), vectors, shared, [m], metric, alpha).drop("layer")
    near = cut(knn_graph(vectors, 2 * m, metric).select("src", "dst", "dist"))
    back = near.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "dist")
    back = back.withColumn("rn", F.row_number().over(W.partitionBy("src").orderBy("dist", "dst"))).filter(F.col("rn") <= 2 * m).drop("rn")
    return select_neighbors(near.unionByName(back), vectors, 2 * m, alpha, metric=metric)


#: Edges on their way to the task that selects them: many of a layer in one row, as places in the sorted ids.
OFFERS = "part int, layer int, back boolean, src binary, dst binary, dist binary"


def _offered(vectors: DataFrame, shared: Broadcast, degrees: list[int], levels: np.ndarray, metric: str) -> DataFrame:
    """Rows of OFFERS for _chosen(): at each layer, the exact nearest of the nodes whose level reaches it, 2 * degree of each, and the same edges turned round.
    Tasks hold all vectors, so only places in them are dealt; shared: as held_by_all() gives them, levels: of these nodes."""
    spark, n, how, tile = vectors.sparkSession, len(levels), Distances(metric), topk.TILE
    parts = 2 * spark.sparkContext.defaultParallelism
    reach = spark.sparkContext.broadcast(levels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (ids, v), level, tiles = shared.value, reach.value, {}
        for whole in batches:
            places = np.asarray(whole.column(0))
            for at in np.array_split(places, -(-len(places) // topk.BLOCK)) if len(places) else ():
                rows = []
                for k, degree in enumerate(degrees):
                    mine = at[level[at] >= k]
                    if not len(mine):
                        break
                    if k not in tiles:
                        held = np.flatnonzero(level >= k)
                        tiles[k] = [(x, how.rows_of(v[x].astype(float))) for x in np.split(held, range(4096, len(held), 4096))]
                    src, dist, dst = topk.scan_tiles((mine, v[mine].astype(float)), tiles[k], 2 * degree, how, True, tile)
                    src = mine[src]
                    for back, a, b in ((False, src, dst), (True, dst, src)):
                        to = a % parts
                        order = np.argsort(to.astype(np.uint16) if parts < 2**16 else to, kind="stable")
                        ends = np.cumsum(np.bincount(to, minlength=parts))[:-1]
                        columns = [np.split(x[order], ends) for x in (a.astype(np.int32), b.astype(np.int32), dist)]
                        rows += [(p, k, back, *(x.tobytes() for x in part)) for p, part in enumerate(zip(*columns, strict=True)) if len(part[0])]
                kinds = pa.int32(), pa.int32(), pa.bool_(), pa.binary(), pa.binary(), pa.binary()
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True) if rows else [()] * 6, kinds, strict=True)], names=["part", "layer", "back", "src", "dst", "dist"])

    return spark.range(0, n, 1, parts).mapInArrow(run, OFFERS)


def _chosen(offered: DataFrame, vectors: DataFrame, shared: Broadcast, degrees: list[int], metric: str, alpha: float = ALPHA) -> DataFrame:
    """(layer, src, dst, dist): diverse neighbours, 2 * degree at most, of each node at each layer, from the nearest that it is offered and the 2 * degree nearest of
    those that it is among the nearest of. A task gets all that is offered to its nodes, and sorts it there."""
    kind, parts = vectors.schema["id"].dataType.simpleString(), 2 * vectors.sparkSession.sparkContext.defaultParallelism

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (ids, v), offers = shared.value, {}
        for batch in batches:
            for k, back, *columns in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
                offers.setdefault((k, back), []).append([np.frombuffer(x, t) for x, t in zip(columns, (np.int32, np.int32, float), strict=True)])
        for k, degree in enumerate(degrees):
            both = []
            for back in (False, True):
                src, dst, dist = (np.concatenate(x) for x in zip(*offers.pop((k, back), [[np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0)]]), strict=True))
                if back:
                    order = np.lexsort((dst, dist, src))
                    src, dst, dist = src[order], dst[order], dist[order]
                    keep = np.arange(len(src)) - np.searchsorted(src, src) < 2 * degree
                    src, dst, dist = src[keep], dst[keep], dist[keep]
                both.append((src, dst, dist))
            src, dst, dist = (np.concatenate(x) for x in zip(*both, strict=True))
            order = np.lexsort((dst, dist, src))
            src, dst, dist = src[order], dst[order], dist[order]
            keep = np.r_[True, (src[1:] != src[:-1]) | (dst[1:] != dst[:-1])][: len(src)]
            src, dst, dist = src[keep], dst[keep], dist[keep]
            first = np.flatnonzero(np.diff(src, prepend=-1))
            count = np.diff(np.r_[first, len(src)])
            for some in np.unique(count):  # nodes with as many candidates are taken together
                alike, step = first[count == some], max(1, HELD // (int(some) * max(1, v.shape[1], int(some))))
                for lo in range(0, len(alike), step):
                    at = alike[lo : lo + step, None] + np.arange(some)
                    at = at[_spread(v[dst[at]].astype(float), dist[at], 2 * degree, alpha, True, metric)] if some > 2 * degree else at.ravel()
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, np.int32)), pa.array(ids[src[at]]), pa.array(ids[dst[at]]), pa.array(dist[at])], names=["layer", "src", "dst", "dist"])

    return offered.repartitionById(parts, F.col("part")).mapInArrow(run, f"layer int, src {kind}, dst {kind}, dist double")


def insert(edges: DataFrame, vectors: DataFrame, new: DataFrame, m: int = 16, ef: int = 64, entries: DataFrame | None = None, metric: str = "l2", alpha: float = ALPHA) -> DataFrame:
    """(src, dst, dist): the graph with new vectors (id, v) linked into it. Each new node's neighbours are selected from the ef nearest that a search of the graph
    finds and from its nearest among the new ones; nodes that they lead to take the edge back, and select anew."""
    queries = new.select(F.col("id").alias("qid"), F.col("v").alias("q"))
    entries = entries if entries is not None else ranked(hub_scores(edges), 8, "in_degree", "node", descending=True).select("node")
    found = beam_search(edges, vectors.select("id", "v"), queries, entries, ef, metric).select(F.col("qid").alias("src"), F.col("id").alias("dst"), F.col("distance").alias("dist"))
    among = knn_graph(new, 2 * m, metric).select("src", "dst", "dist")
    every = vectors.select("id", "v").unionByName(new.select("id", "v"))
    known = (held_by_all(every),)
    out = cut(select_neighbors(found.unionByName(among), every, 2 * m, alpha, metric=metric, held=known))
    back = out.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "dist")
    touched = back.select("src").distinct()
    held = edges.select("src", "dst", "dist").unionByName(out)
    anew = select_neighbors(held.join(touched, "src", "left_semi").unionByName(back).groupBy("src", "dst").agg(F.min("dist").alias("dist")), every, 2 * m, alpha, metric=metric, held=known)
    return held.join(touched, "src", "left_anti").unionByName(anew)


def layers(vectors: DataFrame, m: int = 16, metric: str = "l2") -> DataFrame:
    """(layer, src, dst, dist): a graph of all nodes at layer 0 and, at each layer above, one of the nodes whose level reaches it, with half as many edges.
    Where every task can hold all vectors, all layers are built at once."""
    shared = held_by_all(vectors) if metric in ("l2", "cosine") else None
    if shared is not None and (n := len(ids := shared.value[0])) <= EXACT_ROWS:
        above = vectors.select("id", level(F.col("id"), m).alias("level")).filter("level > 0").toArrow()
        levels = np.zeros(n, np.int8)
        levels[places(ids, np.asarray(above.column(0).combine_chunks()))] = np.asarray(above.column(1).combine_chunks())
        degrees = [m] + [max(1, m // 2)] * int(levels.max())
        return _chosen(_offered(vectors, shared, degrees, levels, metric), vectors, shared, degrees, metric)
    nodes = cut(vectors.select("id", "v").withColumn("level", level(F.col("id"), m)))
    top = nodes.agg(F.max("level")).first()[0] or 0
    out = build(nodes.select("id", "v"), m, metric).select(F.lit(0).alias("layer"), "src", "dst", "dist")
    for k in range(1, top + 1):
        some = nodes.filter(F.col("level") >= k).select("id", "v")
        out = out.unionByName(build(some, max(1, m // 2), metric).select(F.lit(k).alias("layer"), "src", "dst", "dist"))
    return out


def entry_point(nodes: DataFrame) -> DataFrame:
    """One row (id): the least node of the highest level, of nodes (id, level)."""
    return nodes.orderBy(F.desc("level"), "id").limit(1).select("id")


def descend(edges: DataFrame, nodes: DataFrame, queries: DataFrame, distance: Column | str = "l2") -> DataFrame:
    """(qid, id): for each query, where greedy steps through the layers above 0 lead from the entry point; nodes: (id, level, ...), edges with layer. The upper
    layers hold a few of the nodes."""
    at = entry_point(nodes)
    top = nodes.agg(F.max("level")).first()[0] or 0
    upper = cut(nodes.filter(F.col("level") >= 1))
    for k in range(top, 0, -1):
        at = beam_search(edges.filter(F.col("layer") == k), upper, queries, at, 1, distance).select("qid", "id")
    return at


def search_layers(edges: DataFrame, nodes: DataFrame, queries: DataFrame, ef: int, distance: Column | str = "l2") -> DataFrame:
    """(qid, id, distance, rank): the ef nearest that are found by greedy descent through the layers and a beam over layer 0."""
    return beam_search(edges.filter(F.col("layer") == 0), nodes, queries, descend(edges, nodes, queries, distance), ef, distance)


def compact(nodes: DataFrame, dim: int) -> DataFrame:
    """One row: nodes, upper_nodes, vector_bytes before and freed_bytes by dropping the lowest layer's vectors; nodes: (id, level)."""
    return nodes.agg(
        F.count(F.lit(1)).alias("nodes"), F.count_if(F.col("level") >= 1).alias("upper_nodes"),
        (F.count(F.lit(1)) * dim * 4).alias("vector_bytes"), (F.count_if(F.col("level") == 0) * dim * 4).alias("freed_bytes"),
    )
