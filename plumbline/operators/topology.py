"""Topology of neighbourhoods: ego-graphs, Betti numbers, persistence, reranking, sheaf consistency."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions import vectors as V
from plumbline.operators.graph import khop

CAP = 500


def _inside(members: DataFrame, edges: DataFrame, key: list[str]) -> DataFrame:
    """(key, u, w, dist): the undirected edges among each group's members (key, node)."""
    e = edges.select("src", "dst", "dist")
    first = members.join(e, F.col("node") == F.col("src")).select(*key, "src", "dst", "dist")
    both = first.join(members.withColumnRenamed("node", "dst"), [*key, "dst"])
    return both.groupBy(*key, F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("w")).agg(F.min("dist").alias("dist"))


def ego_single(edges: DataFrame, starts: DataFrame, hops: int = 1) -> tuple[DataFrame, DataFrame]:
    """Members (ego, node) and undirected edges (ego, u, w, dist) of the nodes within some hops of each start."""
    members = khop(edges, starts, hops, with_start=True).select(F.col("start").alias("ego"), "node")
    return members, _inside(members, edges, ["ego"])


def ego_pair(edges: DataFrame, pairs: DataFrame, hops: int = 2) -> tuple[DataFrame, DataFrame]:
    """Members (x, y, node) and edges (x, y, u, w, dist) of both nodes' neighbourhoods; pairs: (x, y)."""
    starts = pairs.select(F.col("x").alias("s")).unionByName(pairs.select(F.col("y").alias("s"))).distinct()
    ball = khop(edges, starts, hops, with_start=True).select("start", "node")
    sides = [pairs.select("x", "y", F.col(c).alias("start")) for c in ("x", "y")]
    members = sides[0].unionByName(sides[1]).join(ball, "start").select("x", "y", "node").distinct()
    return members, _inside(members, edges, ["x", "y"])


def cap_edges(ego_edges: DataFrame, n: int = CAP, key: tuple[str, ...] = ("ego",), by_weight: bool = False) -> DataFrame:
    """The first n edges of each group by (u, w), or by (dist, u, w)."""
    order = (["dist"] if by_weight else []) + ["u", "w"]
    return ego_edges.withColumn("_rn", F.row_number().over(W.partitionBy(*key).orderBy(*order))).filter(F.col("_rn") <= n).drop("_rn")


def components_of(members: DataFrame, ego_edges: DataFrame, key: list[str]) -> DataFrame:
    """(key, beta0): connected components of each group, by union-find inside the group; groups are bounded by the graph's degree and the cap."""
    nodes = members.select(*key, F.col("node").alias("u"), F.col("node").alias("w"))
    rows = nodes.unionByName(ego_edges.select(*key, "u", "w"))
    kinds = ", ".join(f"{k} {members.schema[k].dataType.simpleString()}" for k in key)

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        up: dict[int, int] = {}

        def top(x: int) -> int:
            while up.setdefault(x, x) != x:
                up[x] = x = up[up[x]]
            return x

        for u, w in zip(pdf["u"], pdf["w"], strict=True):
            a, b = top(u), top(w)
            up[max(a, b)] = min(a, b)
        return pd.DataFrame([[*(pdf[k].iat[0] for k in key), sum(1 for x in up if up[x] == x)]], columns=[*key, "beta0"])

    return rows.groupBy(*key).applyInPandas(count, f"{kinds}, beta0 long")


def betti(members: DataFrame, ego_edges: DataFrame, key: tuple[str, ...] = ("ego",), connected: bool = False) -> DataFrame:
    """(key, nv, ne, beta0, beta1, euler). ``connected``: every group is known to be connected, as uncapped one-start neighbourhoods are."""
    k = list(key)
    nv = members.groupBy(*k).agg(F.countDistinct("node").alias("nv"))
    ne = ego_edges.groupBy(*k).agg(F.count(F.lit(1)).alias("ne"))
    df = nv.join(ne, k, "left").withColumn("ne", F.coalesce("ne", F.lit(0).cast("long")))
    df = df.withColumn("beta0", F.lit(1).cast("long")) if connected else df.join(components_of(members, ego_edges, k), k)
    return df.withColumn("euler", F.col("nv") - F.col("ne")).withColumn("beta1", F.greatest(F.col("beta0") - F.col("nv") + F.col("ne"), F.lit(0).cast("long")))


def d_total(cosine: Column | str, structure: Column | str, edges: Column | str, alpha: float, beta: float) -> Column:
    """alpha * distance + beta * exp(-structure / edges): dense neighbourhoods come nearer."""
    c, s, e = (F.col(x) if isinstance(x, str) else x for x in (cosine, structure, edges))
    return alpha * c + beta * F.exp(-s / F.greatest(e, F.lit(1)))


def ego_stats(edges: DataFrame, nodes: DataFrame, hops: int = 1, cap: int = CAP) -> DataFrame:
    """(ego, nv, ne, beta0, beta1, euler) of each node's neighbourhood. Whole ones are connected, as all their nodes hang on the centre; those with more than ``cap`` edges keep the first,
    and their components are counted. A member is moved to its ego with all that it leads to, in one row, not with a row for each of its edges."""
    members = khop(edges, nodes, hops, with_start=True).select(F.col("start").alias("ego"), "node")
    kind = members.schema["node"].dataType.simpleString()
    to = edges.groupBy(F.col("src").alias("node")).agg(F.collect_set("dst").alias("to"))
    rows = members.join(to, "node", "left").select("ego", "node", F.coalesce("to", F.array().cast(f"array<{kind}>")).alias("to")).repartition("ego").sortWithinPartitions("ego")

    def one(ego, node: np.ndarray, to: np.ndarray, of: np.ndarray) -> tuple:
        own = np.unique(node)
        at = np.minimum(np.searchsorted(own, to), len(own) - 1)
        inside = own[at] == to
        u, w = np.searchsorted(own, of[inside]), at[inside]
        pairs = np.unique(np.minimum(u, w) * len(own) + np.maximum(u, w))
        if len(pairs) <= cap:
            return ego, len(own), len(pairs), 1
        up = np.arange(len(own)).tolist()

        def top(x: int) -> int:
            while up[x] != x:
                up[x] = x = up[up[x]]
            return x

        for u, w in zip((pairs[:cap] // len(own)).tolist(), (pairs[:cap] % len(own)).tolist(), strict=True):
            a, b = top(u), top(w)
            up[max(a, b)] = min(a, b)
        return ego, len(own), cap, sum(1 for i, x in enumerate(up) if i == x)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(table: pa.Table) -> pa.RecordBatch:
            ego, node = (np.asarray(table.column(i).combine_chunks()) for i in (0, 1))
            lists = table.column(2).combine_chunks()
            to, n = np.asarray(lists.flatten()), np.asarray(pc.list_value_length(lists))
            of, ends = np.repeat(node, n), np.r_[0, np.cumsum(n)]
            first = np.flatnonzero(np.r_[True, ego[1:] != ego[:-1]])
            last = np.r_[first[1:], len(ego)]
            found = [one(ego[a], node[a:b], to[ends[a] : ends[b]], of[ends[a] : ends[b]]) for a, b in zip(first, last, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(np.array(c)) for c in zip(*found, strict=True)], names=["ego", "nv", "ne", "beta0"])

        left = None
        for batch in batches:
            table = pa.Table.from_batches([batch]) if left is None else pa.concat_tables([left, pa.Table.from_batches([batch])])
            if not table.num_rows:
                continue
            ego = np.asarray(table.column(0).combine_chunks())
            if k := int(np.searchsorted(ego, ego[-1])):
                yield done(table.slice(0, k))
            left = table.slice(k)
        if left is not None and left.num_rows:
            yield done(left)

    df = rows.mapInArrow(run, f"ego {members.schema['ego'].dataType.simpleString()}, nv long, ne long, beta0 long").withColumn("euler", F.col("nv") - F.col("ne"))
    return df.withColumn("beta1", F.greatest(F.col("beta0") - F.col("nv") + F.col("ne"), F.lit(0).cast("long"))).select("ego", "nv", "ne", "beta0", "beta1", "euler")


def rerank(candidates: DataFrame, stats: DataFrame, alpha: float = 0.7, beta: float = 0.3) -> DataFrame:
    """Candidates (qid, id, cosine) with d_total and its rank, by their neighbourhoods' stats; a node without one is a single vertex."""
    s = stats.select(F.col("ego").alias("id"), "beta1", "ne")
    df = candidates.join(s, "id", "left").withColumn("d_total", d_total("cosine", F.coalesce("beta1", F.lit(0)), F.coalesce("ne", F.lit(0)), alpha, beta))
    return df.withColumn("d_rank", F.row_number().over(W.partitionBy("qid").orderBy("d_total", "id")).cast("long"))


def rerank_pairwise(candidates: DataFrame, edges: DataFrame, alpha: float = 0.7, beta: float = 0.3, cap: int = CAP) -> DataFrame:
    """(qid, id, mean_d): the mean over a query's other candidates of the pair's d_total; 0 for a single candidate. A query has few candidates."""
    a, b = candidates.select("qid", F.col("id").alias("x"), "cosine"), candidates.select("qid", F.col("id").alias("y"))
    pairs = a.join(b, "qid").filter("x != y")
    members, inside = ego_pair(edges, pairs.select("x", "y").distinct())
    stats = betti(members, cap_edges(inside, cap, ("x", "y")), ("x", "y"))
    scored = pairs.join(stats, ["x", "y"]).withColumn("d", d_total("cosine", "beta1", "ne", alpha, beta))
    mean = scored.groupBy("qid", F.col("x").alias("id")).agg(F.avg("d").alias("mean_d"))
    return candidates.select("qid", "id").join(mean, ["qid", "id"], "left").withColumn("mean_d", F.coalesce("mean_d", F.lit(0.0)))


def _pairs_of(pdf: pd.DataFrame) -> list[tuple[int, float, float]]:
    """Persistence pairs (dimension, birth, death) of one weighted graph with columns u, w, dist."""
    edges = sorted(zip(pdf["dist"], pdf["u"], pdf["w"], strict=True))
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = x = up[up[x]]
        return x

    out: list[tuple[int, float, float]] = []
    births: list[float] = []
    near: dict[int, dict[int, float]] = {}
    for d, u, w in edges:
        a, b = top(u), top(w)
        if a == b:
            births.append(d)
        else:
            up[max(a, b)] = min(a, b)
            if d > 1e-10:
                out.append((0, 0.0, d))
        near.setdefault(u, {})[w] = near.setdefault(w, {})[u] = d
    triangles = sorted(max(d, near[u][x], near[w][x]) for d, u, w in edges for x in near[u].keys() & near[w].keys() if max(u, w) < x)
    at = 0
    for birth in births:
        while at < len(triangles) and triangles[at] < birth:
            at += 1
        if at < len(triangles):
            if triangles[at] - birth > 1e-10:
                out.append((1, birth, triangles[at]))
            at += 1
        else:
            out.append((1, birth, edges[-1][0]))
    return out


def persistence(ego_edges: DataFrame) -> DataFrame:
    """(ego, dim, birth, death): persistence pairs of each group; a group holds at most the cap's edges."""
    kind = ego_edges.schema["ego"].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(pdf["ego"].iat[0], *p) for p in _pairs_of(pdf)], columns=["ego", "dim", "birth", "death"])

    return ego_edges.select("ego", "u", "w", "dist").groupBy("ego").applyInPandas(run, f"ego {kind}, dim int, birth double, death double")


def diagram_stats(pairs: DataFrame, weight: float = 1.0) -> DataFrame:
    """Per ego: totals and counts by dimension, the greatest persistence, and score (dimension 0 and ``weight`` times dimension 1)."""
    p, zero, one = F.abs(F.col("death") - F.col("birth")), F.col("dim") == 0, F.col("dim") == 1
    total = lambda c: F.coalesce(F.sum(F.when(c, p)), F.lit(0.0))
    df = pairs.groupBy("ego").agg(total(zero).alias("h0_total"), total(one).alias("h1_total"), F.count_if(zero).alias("h0_count"), F.count_if(one).alias("h1_count"), F.max(p).alias("max_persistence"))
    return df.withColumn("total", F.col("h0_total") + F.col("h1_total")).withColumn("score", F.col("h0_total") + weight * F.col("h1_total"))


def triangles(ego_edges: DataFrame) -> DataFrame:
    """(ego, a, b, c, weight): the triangles of each group with a < b < c; the weight is the longest side."""
    e = ego_edges.select("ego", "u", "w", "dist")
    ab = e.withColumnsRenamed({"u": "a", "w": "b", "dist": "d1"})
    bc = e.withColumnsRenamed({"u": "b", "w": "c", "dist": "d2"})
    ac = e.withColumnsRenamed({"u": "a", "w": "c", "dist": "d3"})
    return ab.join(bc, ["ego", "b"]).join(ac, ["ego", "a", "c"]).select("ego", "a", "b", "c", F.greatest("d1", "d2", "d3").alias("weight"))


def node_stalks(stalks: DataFrame) -> DataFrame:
    """(node, stalk): the mean of a node's modalities over their common length; nodes without common values are left out. stalks: (node, modality, values)."""
    sized = stalks.groupBy("node").agg(F.min(F.size("values")).alias("n")).filter("n > 0")
    flat = stalks.join(sized, "node").select("node", "n", F.posexplode("values").alias("pos", "x")).filter("pos < n")
    means = flat.groupBy("node", "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    one = means.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("pos", "m"))).alias("a"))  # a stalk's length of values
    return one.select("node", F.transform("a", lambda s: s["m"]).alias("stalk"))


def restrict(v: Column | str, rows: Column | None = None) -> Column:
    """A restriction map given by its matrix' rows; the identity without one."""
    v = F.col(v) if isinstance(v, str) else v
    return v if rows is None else F.transform(rows, lambda r: V.dot(r, F.slice(v, F.lit(1), F.size(r))))


def sheaf_edges(stalks: DataFrame, edges: DataFrame, maps: DataFrame | None = None) -> DataFrame:
    """(src, dst, cocycle, obstruction) of the edges whose nodes both have a stalk; maps: (src, dst, src_map, dst_map), matrices by rows."""
    s = node_stalks(stalks)
    df = edges.select("src", "dst").join(s.select(F.col("node").alias("src"), F.col("stalk").alias("a")), "src").join(s.select(F.col("node").alias("dst"), F.col("stalk").alias("b")), "dst")
    if maps is not None:
        df = df.join(maps, ["src", "dst"], "left")
        fa = F.when(F.col("src_map").isNotNull(), restrict("a", F.col("src_map"))).otherwise(F.col("a"))
        fb = F.when(F.col("dst_map").isNotNull(), restrict("b", F.col("dst_map"))).otherwise(F.col("b"))
    else:
        fa, fb = F.col("a"), F.col("b")
    df = df.withColumn("fa", fa).withColumn("fb", fb).withColumn("n", F.least(F.size("fa"), F.size("fb")))
    df = df.withColumn("cocycle", F.zip_with(F.slice("fa", F.lit(1), F.col("n")), F.slice("fb", F.lit(1), F.col("n")), lambda x, y: x - y))
    return df.select("src", "dst", "cocycle", (V.dot("cocycle", "cocycle") / (V.dot("a", "a") + V.dot("b", "b") + 1e-8)).alias("obstruction"))


def sheaf_h1(edge_rows: DataFrame, threshold: float = 0.1) -> DataFrame:
    """One row: edge_count, h1 (the mean obstruction, 0 without edges), is_consistent (h1 below the threshold)."""
    df = edge_rows.agg(F.count(F.lit(1)).alias("edge_count"), F.coalesce(F.avg("obstruction"), F.lit(0.0)).alias("h1"))
    return df.withColumn("is_consistent", F.col("h1") < threshold)


def coherence(stalks: DataFrame) -> DataFrame:
    """(node, coherence): the mean cosine of a node's pairs of modalities; 1 with fewer than two."""
    a = stalks.select("node", F.col("modality").alias("m1"), F.col("values").alias("q"))
    b = stalks.select("node", F.col("modality").alias("m2"), F.col("values").alias("v"))
    pairs = a.join(b, "node").filter("m1 < m2").groupBy("node").agg(F.avg(V.sheaf_cosine("q", "v")).alias("c"))
    return stalks.select("node").distinct().join(pairs, "node", "left").select("node", F.coalesce("c", F.lit(1.0)).alias("coherence"))
