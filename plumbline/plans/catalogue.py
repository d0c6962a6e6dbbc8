"""Every query of the vector engine on the embeddings table, and its DuckDB SQL."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import matrices as M
from plumbline.functions import vectors as V
from plumbline.operators import bitplane, evaluate, graph, index, rabitq, store, topk, topology
from plumbline.plans.cutting import cut, shared_folder
from plumbline.schema import METADATA, IndexConfig, SearchConfig
from plumbline.sources import files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

DIM, K, DEGREE = 64, 10, 16
#: The vectors that searches take as queries, against all: every one whose id is divisible by this.
STEP = 100
#: A fixed plane for the locality key.
PLANE = [((i * 37) % 17 - 8) / 8 for i in range(DIM)]


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = "with " + sql.strip()
        return f

    return add


def r6(c: Column | str) -> Column:
    """Rounded to six digits; adding 0 makes a negative zero positive."""
    return F.round(c, 6) + F.lit(0.0)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")


def query_batch(base: DataFrame) -> DataFrame:
    return base.filter(F.col("id") % STEP == 0).select(F.col("id").alias("qid"), F.col("v").alias("q"))


def folder(spark: SparkSession, name: str) -> str:
    """A new folder for a query's tables, in the shared one."""
    return f"{shared_folder(spark).rstrip('/')}/plumbline-{name}-{uuid.uuid4().hex}"


def both(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    base = vectors(spark, sf_dir)
    return query_batch(base), base.select("id", "v")


def edges_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut(graph.knn_graph(vectors(spark, sf_dir).select("id", "v"), DEGREE))


# ---- SQL pieces
E = "e as (select vec_id as id, list_transform(embedding, lambda x: x::double) as v, label from embeddings)"
P = f"{E}, p as (select a.id as qid, b.id as id, a.v as q, b.v as v from e a join e b on a.id % {STEP} = 0 and a.id <> b.id)"
L2 = "list_sum(list_transform(list_zip(q, v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
HAMMING = "list_sum(list_transform(list_zip(q, v), lambda z: ((z[1] > 0) <> (z[2] > 0))::int))"
KNN = f"""{E}, knn as (select src, dst, d, rn from (select a.id as src, b.id as dst, list_distance(a.v, b.v) ** 2 as d,
  row_number() over (partition by a.id order by list_distance(a.v, b.v) ** 2, b.id) as rn from e a join e b on a.id <> b.id) where rn <= {DEGREE})"""
EGO = f"""{KNN}, m as (select distinct src as ego, src as node from knn union select src, dst from knn),
ee as (select m1.ego, least(k.src, k.dst) as u, greatest(k.src, k.dst) as w, min(k.d) as d from m m1 join knn k on k.src = m1.node join m m2 on m2.ego = m1.ego and m2.node = k.dst group by all),
st as (select ego, nv, ne, ne - nv + 1 as beta1 from (select ego, count(*) as nv from m group by 1) join (select ego, count(*) as ne from ee group by 1) using (ego))"""


def _top(values: str, k: int = K, n: str = "rn") -> str:
    return f"select qid, id, {values}, row_number() over (partition by qid order by d, id) as {n} from p"


def kernel(name: str, by: M.Kernel, sql: str, missing: float | None = None, parts: tuple[int, int] | None = None) -> None:
    """A query that gives one value for every pair of a query and another vector; missing: the value of a null vector. parts: so many numbers of each are taken."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        q, base = both(spark, sf_dir)
        if parts is not None:
            q, base = q.withColumn("q", F.slice("q", 1, parts[0])), base.withColumn("v", F.slice("v", 1, parts[1]))
        return topk.pairs_by(q, base, by, missing, parts is not None, 6).withColumnRenamed("distance", "value")

    run.__name__ = name
    query(f"{P} select qid, id, round({sql}, 6) as value from p")(run)


COS = "greatest(-1.0, least(1.0, list_cosine_similarity(q, v)))"
kernel("cosine_distance_quant", M.cosine_distance(), f"1 - {COS}", V.ZERO["unit"])
kernel("cosine_distance_graph", M.cosine_distance("graph"), f"1 - {COS}", V.ZERO["graph"])
kernel("cosine_distance_store", M.cosine_distance("half"), f"(1 - {COS}) / 2", V.ZERO["half"])
kernel("cosine_similarity", M.cosine_similarity, COS, 0.0)
kernel("cosine_distance_bulk", M.bulk_cosine_distance, "1 - list_cosine_similarity(q, v)", 2.0)
kernel("retrieval_score", M.retrieval_score(), f"1 - (1 - {COS}) / 2", 0.0)
kernel("retrieval_score_l2", M.retrieval_score("l2"), f"1 / (1 + {L2})")
kernel("l2_squared", M.l2_sq, L2)
kernel("dot_product", M.dot, "list_dot_product(q, v)")
kernel("hamming_all", M.hamming, HAMMING + "::double")
kernel("sheaf_cosine", M.sheaf_cosine, "greatest(0.0, least(1.0, list_cosine_similarity(q[1:32], v[1:32])))", 1.0, (40, 32))


@query(f"{E} select id, round(sqrt(list_dot_product(v, v)), 6) as norm from e")
def l2_norm(spark, sf_dir):
    return vectors(spark, sf_dir).select("id", r6(V.norm("v")).alias("norm"))


@query(f"{E}, n as (select id, sqrt(list_dot_product(v, v)) as n, unnest(v) as x, generate_subscripts(v, 1) - 1 as pos from e) select id, pos, round(x / n, 6) as x from n")
def normalize(spark, sf_dir):
    return vectors(spark, sf_dir).select("id", F.posexplode(V.normalize("v")).alias("pos", "x")).select("id", F.col("pos").cast("long").alias("pos"), r6("x").alias("x"))


@query(f"{E} select id, round(list_dot_product(v, {json.dumps(PLANE)}::double[]), 6) as key from e")
def random_projection(spark, sf_dir):
    return vectors(spark, sf_dir).select("id", r6(V.projection("v", PLANE)).alias("key"))


def _words(op: str) -> str:
    word = lambda k: f"list_sum(list_transform(range(0, 32), lambda i: case when v[{k * 32} + i + 1] {op} 0 then (1::bigint << i) else 0 end))::bigint"
    return f"{E} select id, {word(0)} as w0, {word(1)} as w1 from e"


@query(_words(">"))
def quantize_binary(spark, sf_dir):
    return vectors(spark, sf_dir).select("id", V.sign_bits("v", 32).alias("w")).select("id", F.get("w", 0).alias("w0"), F.get("w", 1).alias("w1"))


@query(_words(">="))
def quantize_binary_graph(spark, sf_dir):
    return vectors(spark, sf_dir).select("id", V.sign_bits("v", 32, True).alias("w")).select("id", F.get("w", 0).alias("w0"), F.get("w", 1).alias("w1"))


def _coded(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    q, base = both(spark, sf_dir)
    return q.select("qid", V.sign_bits("q").alias("q")), base.select("id", V.sign_bits("v").alias("v"))


def shown(df: DataFrame, value: str = "distance") -> DataFrame:
    return df.select("qid", "id", r6(F.col(value).cast("double")).alias("distance"), "rank")


def top_sql(distance: str, k: int = K, ctes: str = P, where: str = "true") -> str:
    return f"""{ctes}, d as (select qid, id, {distance} as d from p where {where}), r as (select qid, id, d, row_number() over (partition by qid order by d, id) as rank from d)
select qid, id, round(d::double, 6) as distance, rank from r where rank <= {k}"""


@query(top_sql(HAMMING))
def hamming_topk(spark, sf_dir):
    return shown(topk.hamming_top_k(*_coded(spark, sf_dir), K))


@query(f"{P}, d as (select qid, id, {HAMMING} as d from p) select qid, min(d)::bigint as distance, arg_min(id, d * 1000000 + id) as id from d group by qid")
def hamming_nearest(spark, sf_dir):
    q, base = _coded(spark, sf_dir)
    d = topk.pairs(q, base, V.hamming("q", "v")).groupBy("qid").agg(F.min(F.struct("distance", "id")).alias("m"))
    return d.select("qid", F.col("m.distance").cast("long").alias("distance"), F.col("m.id").alias("id"))


@query(top_sql(L2))
def topk_l2(spark, sf_dir):
    return shown(topk.top_k(*both(spark, sf_dir), K))


@query(top_sql(f"1 - {COS}"))
def topk_cosine(spark, sf_dir):
    return shown(topk.top_k(*both(spark, sf_dir), K, "cosine"))


@query(top_sql(L2, 100))
def ground_truth(spark, sf_dir):
    return shown(topk.top_k_bulk(*both(spark, sf_dir), 100))


@query(top_sql(f"1 - {COS}"))
def topk_cosine_bulk(spark, sf_dir):
    return shown(topk.top_k_bulk(*both(spark, sf_dir), K, "cosine"))


@query(top_sql(L2, where="v[1] > 0"))
def topk_filtered(spark, sf_dir):
    q, base = both(spark, sf_dir)
    return shown(topk.top_k(q, base.filter(F.get("v", 0) > 0), K))


@query(f"t as (select vec_id as id, list_transform(embedding[1:3], lambda x: sign(x)::double) as v from embeddings), p as (select a.id as qid, b.id as id, a.v as q, b.v as v from t a join t b on a.id % {STEP} = 0 and a.id <> b.id), d as (select qid, id, {L2} as d from p), r as (select qid, id, d, row_number() over (partition by qid order by d, id) as rank from d) select qid, id, round(d, 6) as distance, rank from r where rank <= {5 * K}")
def topk_ties(spark, sf_dir):
    """Eight different vectors, each many times: equal distances go to the smaller id."""
    q, base = both(spark, sf_dir)
    signs = lambda df, c: df.withColumn(c, F.transform(F.slice(c, 1, 3), lambda x: F.signum(x)))
    return shown(topk.top_k_bulk(signs(q, "q"), signs(base, "v"), 5 * K))


# ---- bit planes
_LOW = "x, pow(2.0, floor(log2(abs(x))) + case when pow(2.0, floor(log2(abs(x)))) > abs(x) then -1 when pow(2.0, floor(log2(abs(x))) + 1) <= abs(x) then 1 else 0 end) as low"
FLAT = f"{E}, f as (select id, pos, {_LOW} from (select id, generate_subscripts(v, 1) - 1 as pos, unnest(v) as x from e))"


def _flat(df: DataFrame) -> DataFrame:
    return df.select("id", F.posexplode("x").alias("pos", "x")).select("id", F.col("pos").cast("long").alias("pos"), r6(F.col("x").cast("double")).alias("x"))


@query(f"{FLAT} select id, pos, round(sign(x) * low, 6) as x from f")
def bitplane_coarse(spark, sf_dir):
    return _flat(vectors(spark, sf_dir).select("id", bitplane.coarse("v").alias("x")))


@query(f"{FLAT} select id, pos, round(sign(x) * low, 6) as x from f where id % 5 <> 0")
def bitplane_store(spark, sf_dir):
    """Stored in two tiers, some deleted, and read coarsely."""
    kept = bitplane.BitPlaneStore(spark, folder(spark, "planes"), DIM)
    base = vectors(spark, sf_dir).select("id", "v")
    kept.insert(base)
    kept.delete(base.filter("id % 5 = 0").select("id"))
    return _flat(kept.read(0).withColumnRenamed("v", "x"))


def _partial_sql(step: str) -> str:
    return f"{FLAT}, m as (select id, pos, x, low, round((abs(x) / low - 1) * 8388608)::bigint as m from f) select id, pos, round(sign(x) * low * (1 + ({step}) / 8388608.0::double), 6) as x from m"


@query(_partial_sql("m % 256"))
def bitplane_partial(spark, sf_dir):
    return _flat(vectors(spark, sf_dir).select("id", bitplane.partial("v", 8).alias("x")))


@query(_partial_sql("m - m % 32768"))
def bitplane_partial_msb(spark, sf_dir):
    return _flat(vectors(spark, sf_dir).select("id", bitplane.partial("v", 8, msb=True).alias("x")))


@query(f"{E} select id, generate_subscripts(v, 1) - 1 as pos, round(unnest(v), 6) as x from e")
def bitplane_roundtrip(spark, sf_dir):
    planes = bitplane.decompose(vectors(spark, sf_dir))
    return _flat(bitplane.reconstruct(planes, DIM).withColumnRenamed("v", "x"))


@query(f"{E}, b as (select unnest([0, 8, 16, 23]) as bits), n as (select count(*) as n, max(ceil(len(v) / 8.0))::bigint as plane, max(len(v)) as dim from e) select bits::bigint as bits, n * 9 * plane as coarse_bytes, n * 32 * plane as total_bytes, round((9 + bits) * plane / (4.0::double * dim), 6) as ratio from b, n")
def bitplane_sizes(spark, sf_dir):
    n = vectors(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"), F.max(F.ceil(F.size("v") / 8)).alias("plane"), F.max(F.size("v")).alias("dim"))
    df = n.select("*", F.explode(F.array(*(F.lit(b).cast("long") for b in (0, 8, 16, 23)))).alias("bits"))
    return df.select("bits", (F.col("n") * 9 * F.col("plane")).alias("coarse_bytes"), (F.col("n") * 32 * F.col("plane")).alias("total_bytes"), r6((F.col("bits") + 9) * F.col("plane") / (4.0 * F.col("dim"))).alias("ratio"))


LEVELS = "l as (select * from (values ('coarse', 0), ('partial', 8), ('partial', 23), ('full', 23)) t(level, bits))"


@query(f"{LEVELS} select a.level, a.bits::bigint as bits, round(a.bits / 23.0::double, 6) as confidence, case a.level when 'coarse' then 'Coarse (0 bits)' when 'full' then 'Full (23 bits)' else 'Partial (' || a.bits || ' bits)' end as name, a.level = 'full' or (a.level = 'partial' and a.bits >= 16) as meets_16 from l a")
def degraded_confidence(spark, sf_dir):
    df = spark.createDataFrame([("coarse", 0), ("partial", 8), ("partial", 23), ("full", 23)], "level string, bits long")
    lv, b = F.col("level"), F.col("bits")
    return df.select("level", "bits", r6(bitplane.confidence(b)).alias("confidence"), bitplane.precision_name(lv, b).alias("name"), bitplane.meets(lv, b, F.lit("partial"), F.lit(16)).alias("meets_16"))


# ---- quantised codes
ROTATION = rabitq.rotation(DIM)


def _rabitq_sql(bits: int) -> str:
    h, top = (2**bits - 1) / 2, 2**bits - 1
    code = "(t > 0)::int" if bits == 1 else f"least(round(greatest(-{h}, least({h}, t * 10)) + {h}), {top})::int"
    recon = "2.0 * t - 1" if bits == 1 else f"(t - {h}) / {h}"
    return f"""{E}, rot as (select {json.dumps(ROTATION)}::double[][] as m),
c as (select list(m order by pos) as c from (select pos, avg(x) as m from (select unnest(v) as x, generate_subscripts(v, 1) as pos from e) group by pos)),
r as (select id, list_transform(list_zip(v, c), lambda z: z[1] - z[2]) as r from e, c),
n as (select id, r, sqrt(list_dot_product(r, r)) as nrm from r), u as (select id, r, nrm, list_transform(r, lambda t: t / nrm) as u from n),
x as (select id, nrm, list_transform(m, lambda row: list_dot_product(row, u)) as x, list_transform(m, lambda row: list_dot_product(row, r)) as y from u, rot),
k as (select id, nrm, x, y, list_transform(x, lambda t: {code}) as code from x),
a as (select id, nrm, nrm * nrm as sqr, x, y, code, list_transform(code, lambda t: {recon}) as recon from k),
f as (select *, case when list_dot_product(recon, x) / 8 <= 1e-6 then 0.8 else list_dot_product(recon, x) / 8 end as x0 from a),
g as (select *, 3.8 * nrm * sqrt(greatest(1 / (x0 * x0) - 1, 0)) / sqrt(63) as err from f),
est as (select o.id as qid, g.id, g.sqr + o.sqr - 2 * g.nrm / (g.x0 * 8) * list_dot_product(g.recon, o.y) as raw, g.err * o.nrm as off from g join g o on o.id % {STEP} = 0 and o.id <> g.id)"""


def _codes(spark, sf_dir, bits: int) -> tuple[DataFrame, DataFrame]:
    q, base = both(spark, sf_dir)
    center = cut(rabitq.centroid(base))
    return rabitq.encode_queries(q, center, ROTATION), rabitq.encode(base, center, ROTATION, bits)


def _estimated_top(spark, sf_dir, bits: int, k: int = K) -> DataFrame:
    q, codes = _codes(spark, sf_dir, bits)
    return rabitq.estimated_top_k(codes, q, k, bits, DIM)


def _estimates_of(spark, sf_dir, pairs: DataFrame, bits: int) -> DataFrame:
    q, codes = _codes(spark, sf_dir, bits)
    return rabitq.estimates_of(pairs, codes, q, bits, DIM)


def _estimates(spark, sf_dir, bits: int) -> DataFrame:
    q, codes = _codes(spark, sf_dir, bits)
    return rabitq.estimates(cut(codes), q, bits, DIM)


@query(f"{E} select generate_subscripts(c, 1) - 1 as pos, round(unnest(c), 6) as m from (select list(m order by pos) as c from (select pos, avg(x) as m from (select unnest(v) as x, generate_subscripts(v, 1) as pos from e) group by pos))")
def centroid(spark, sf_dir):
    return rabitq.centroid(vectors(spark, sf_dir)).select(F.posexplode("c").alias("pos", "m")).select(F.col("pos").cast("long").alias("pos"), r6("m").alias("m"))


@query(f"{E}, rot as (select {json.dumps(ROTATION)}::double[][] as m), x as (select id, list_transform(m, lambda row: list_dot_product(row, v)) as x from e, rot) select id, generate_subscripts(x, 1) - 1 as pos, round(unnest(x), 6) + 0.0::double as x from x")
def rabitq_rotate(spark, sf_dir):
    return _flat(vectors(spark, sf_dir).select("id", rabitq.rotate("v", ROTATION).alias("x")))


def _code_query(bits: int) -> Callable:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        _, codes = _codes(spark, sf_dir, bits)
        return codes.select("id", F.array_join("code", ",").alias("code"), r6("sqr_norm").alias("sqr_norm"), r6("norm").alias("norm"), r6("x0").alias("x0"), r6("error_bound").alias("error_bound"))

    run.__name__ = f"rabitq_encode_{bits}bit"
    return query(f"{_rabitq_sql(bits)} select id, array_to_string(code, ',') as code, round(sqr, 6) as sqr_norm, round(nrm, 6) as norm, round(x0, 6) as x0, round(err, 6) as error_bound from g")(run)


for _bits in (1, 4, 7):
    _code_query(_bits)


@query(f"{_rabitq_sql(4)} select qid, id, round(greatest(raw, 0), 6) as estimate, round(raw - off, 6) as lower_bound from est")
def rabitq_estimate(spark, sf_dir):
    return _estimates(spark, sf_dir, 4).select("qid", "id", r6("estimate").alias("estimate"), r6("lower_bound").alias("lower_bound"))


def _est_top_sql(bits: int, k: int = K) -> str:
    return f"{_rabitq_sql(bits)}, p as (select qid, id, greatest(raw, 0) as d from est), rk as (select qid, id, d, row_number() over (partition by qid order by d, id) as rank from p) select qid, id, round(d, 6) as distance, rank from rk where rank <= {k}"


@query(_est_top_sql(4))
def rabitq_topk(spark, sf_dir):
    return shown(_estimated_top(spark, sf_dir, 4), "estimate")


@query(_est_top_sql(1))
def rabitq_topk_1bit(spark, sf_dir):
    return shown(_estimated_top(spark, sf_dir, 1), "estimate")


_PAIR = f"p as (select a.id as qid, b.id as id, a.v as q, b.v as v from e a join e b on a.id % {STEP} = 0 and a.id <> b.id), l2 as (select qid, id, {L2} as d from p)"


@query(f"{_rabitq_sql(4)}, {_PAIR}, rk as (select l2.qid, l2.id, greatest(raw, 0) as est, d, row_number() over (partition by l2.qid order by d, l2.id) as rank from l2 join est using (qid, id)) select qid, id, round(est, 6) as estimated, round(d, 6) as precise, rank from rk where rank <= {K}")
def combined_asymmetric(spark, sf_dir):
    near = cut(topk.top_k_bulk(*both(spark, sf_dir), K))
    found = near.join(_estimates_of(spark, sf_dir, near, 4), ["qid", "id"])
    return found.select("qid", "id", r6("estimate").alias("estimated"), r6("distance").alias("precise"), "rank")


@query(f"{_rabitq_sql(4)}, {_PAIR}, s as (select qid, id, greatest(raw, 0) as est, row_number() over (partition by qid order by greatest(raw, 0), id) as rn from est), rk as (select s.qid, s.id, est, d, row_number() over (partition by s.qid order by d, s.id) as rank from s join l2 using (qid, id) where rn <= {5 * K}) select qid, id, round(est, 6) as estimated, round(d, 6) as precise, rank from rk where rank <= {K}")
def combined_two_phase(spark, sf_dir):
    q, base = both(spark, sf_dir)
    some = _estimated_top(spark, sf_dir, 4, 5 * K)
    return topk.two_phase(some, base, q, K).select("qid", "id", r6("estimate").alias("estimated"), r6("precise").alias("precise"), "rank")


@query(f"{_rabitq_sql(4)}, {_PAIR}, cn as (select qid, id, row_number() over (partition by qid order by d, id) as rn from l2), rk as (select cn.qid, cn.id, greatest(raw, 0) as d, row_number() over (partition by cn.qid order by greatest(raw, 0), cn.id) as rank from cn join est using (qid, id) where rn <= 64) select qid, id, round(d, 6) as distance, rank from rk where rank <= {K}")
def nsw_rabitq_rescore(spark, sf_dir):
    near = topk.top_k_bulk(*both(spark, sf_dir), 64).select("qid", "id")
    return shown(topk.ranked(_estimates_of(spark, sf_dir, near, 4), K, "estimate", "id", "qid"), "estimate")


# ---- graphs
@query(f"{KNN} select src, dst, round(d, 6) as dist, rn as rank from knn")
def knn_graph(spark, sf_dir):
    return graph.knn_graph(vectors(spark, sf_dir).select("id", "v"), DEGREE).select("src", "dst", r6("dist").alias("dist"), "rank")


@query(f"{KNN}, h as (select dst as node, count(*) as in_degree from knn group by 1) select node, in_degree, round(in_degree / max(in_degree) over ()::double, 6) as hub_score from h")
def hub_scores(spark, sf_dir):
    return graph.hub_scores(edges_of(spark, sf_dir)).select("node", "in_degree", r6("hub_score").alias("hub_score"))


@query(f"{KNN}, h as (select dst as node, count(*) as in_degree from knn group by 1) select node, in_degree, row_number() over (order by in_degree desc, node) as rank from h qualify rank <= 10")
def hub_top10(spark, sf_dir):
    return topk.ranked(graph.hub_scores(edges_of(spark, sf_dir)), 10, "in_degree", "node", descending=True).select("node", "in_degree", "rank")


@query(f"{KNN}, s as (select id as start, id as node, 0 as hop from e where id % {STEP} = 0), h1 as (select start, dst as node, 1 as hop from s join knn on src = node), h2 as (select start, dst as node, 2 as hop from h1 join knn on src = node) select start, node, min(hop)::bigint as hop from (select * from h1 union all select * from h2) where start <> node group by all")
def khop_neighbors(spark, sf_dir):
    starts = vectors(spark, sf_dir).filter(F.col("id") % STEP == 0).select("id")
    return graph.khop(edges_of(spark, sf_dir), starts, 2).select("start", "node", F.col("hop").cast("long").alias("hop"))


@query(f"""{KNN}, gone as (select id from e where id % 10 = 0), lost as (select src, dst as lost from knn where dst in (from gone) and src not in (from gone)),
kept as (select src, dst, d from knn where src not in (from gone) and dst not in (from gone)),
want as (select distinct a.src, b.src as dst from lost a join lost b using (lost) where a.src <> b.src), w2 as (select want.* from want anti join kept using (src, dst)),
sc as (select src, dst, list_distance(a.v, b.v) ** 2 as d from w2 join e a on a.id = src join e b on b.id = dst),
deg as (select src, count(*) as n from kept group by 1), rk as (select sc.*, row_number() over (partition by sc.src order by d, dst) + coalesce(n, 0) as place from sc left join deg using (src))
select src, dst, round(d, 6) as dist from kept union all select src, dst, round(d, 6) from rk where place <= {DEGREE}""")
def remove_repair(spark, sf_dir):
    base = vectors(spark, sf_dir).select("id", "v")
    return graph.remove_nodes(edges_of(spark, sf_dir), base, base.filter("id % 10 = 0").select("id"), DEGREE).select("src", "dst", r6("dist").alias("dist"))


_LEVEL = "floor(-ln(((id * 2654435761) % 9999 + 1) / 10000.0::double) / ln(16.0::double))::bigint"


@query(f"{E} select id, {_LEVEL} as level, case when {_LEVEL} >= 1 then 'hot' else 'cold' end as tier from e")
def node_levels(spark, sf_dir):
    lv = graph.level(F.col("id"))
    return vectors(spark, sf_dir).select("id", lv.cast("long").alias("level"), graph.tier(lv).alias("tier"))


@query(f"{E}, l as (select {_LEVEL} as level from e) select count(*) as nodes, count(*) filter (level >= 1) as upper_nodes, count(*) * 256 as vector_bytes, count(*) filter (level = 0) * 256 as freed_bytes from l")
def compact_memory(spark, sf_dir):
    return graph.compact(vectors(spark, sf_dir).select("id", graph.level(F.col("id")).alias("level")), DIM)


@query()
def diverse_neighbors(spark, sf_dir):
    base = vectors(spark, sf_dir).select("id", "v")
    near = cut(graph.knn_graph(base, 4 * DEGREE)).select("src", "dst", "dist")
    return graph.select_neighbors(near, base, DEGREE, fill=False).withColumn("dist", r6("dist"))


@query()
def graph_backfill(spark, sf_dir):
    base = vectors(spark, sf_dir).select("id", "v")
    return graph.backfill(edges_of(spark, sf_dir), base, 2 * DEGREE).withColumn("dist", r6("dist"))


@query()
def partitioned_build(spark, sf_dir):
    return graph.build_partitioned(vectors(spark, sf_dir).select("id", "v"), DEGREE).withColumn("dist", r6("dist"))


@query()
def graph_search(spark, sf_dir):
    base = vectors(spark, sf_dir).select("id", "v")
    q = query_batch(base)
    edges = graph.build_partitioned(base, DEGREE)
    hubs = topk.ranked(graph.hub_scores(edges), 8, "in_degree", "node", descending=True).select("node")
    return shown(graph.beam_search(edges, base, q, hubs, 64))


# ---- topology
@query(f"{EGO} select ego, u, w, round(d, 6) as dist from ee")
def ego_single(spark, sf_dir):
    edges = edges_of(spark, sf_dir)
    return topology.ego_single(edges, edges.select("src").distinct())[1].select("ego", "u", "w", r6("dist").alias("dist"))


@query(f"{EGO}, r as (select *, row_number() over (partition by ego order by d, u, w) as rn from ee) select ego, u, w, round(d, 6) as dist from r where rn <= 20")
def ego_cap_by_weight(spark, sf_dir):
    edges = edges_of(spark, sf_dir)
    inside = topology.ego_single(edges, edges.select("src").distinct())[1]
    return topology.cap_edges(inside, 20, by_weight=True).select("ego", "u", "w", r6("dist").alias("dist"))


@query(f"{EGO} select ego, nv, ne, 1::bigint as beta0, beta1, nv - ne as euler from st")
def betti(spark, sf_dir):
    edges = edges_of(spark, sf_dir)
    return topology.ego_stats(edges, edges.select("src").distinct()).select("ego", "nv", "ne", "beta0", "beta1", "euler")


@query(f"""recursive {EGO}, c as (select ego, u, w from (select *, row_number() over (partition by ego order by u, w) as rn from ee) where rn <= 12), s as (select ego, u as a, w as b from c union select ego, w, u from c),
reach(ego, node, far) as (select ego, node, node from m union select r.ego, r.node, s.b from reach r join s on s.ego = r.ego and s.a = r.far),
b as (select ego, count(*) as beta0 from (select ego, node, min(far) as root from reach group by all) where node = root group by 1), n as (select ego, count(*) as ne from c group by 1)
select ego, nv, n.ne, beta0, greatest(beta0 - nv + n.ne, 0) as beta1, nv - n.ne as euler from st join b using (ego) join n using (ego)""")
def betti_capped(spark, sf_dir):
    edges = edges_of(spark, sf_dir)
    return topology.ego_stats(edges, edges.select("src").distinct(), cap=12).select("ego", "nv", "ne", "beta0", "beta1", "euler")


_BALLS = f"""{KNN}, pr as (select id as x, id + 1 as y from e where id % {STEP} = 0), b0 as (select x as s from pr union select y from pr),
b1 as (select s, s as node from b0 union select s, dst from b0 join knn on src = s), b2 as (select s, node from b1 union select s, dst from b1 join knn on src = node),
m as (select x, y, node from pr join b2 on s = x union select x, y, node from pr join b2 on s = y),
ee as (select distinct m1.x, m1.y, least(src, dst) as u, greatest(src, dst) as w from m m1 join knn on src = m1.node join m m2 on m2.x = m1.x and m2.y = m1.y and m2.node = dst)"""


@query(f"{_BALLS} select x, y, nv, ne from (select x, y, count(*) as nv from m group by all) join (select x, y, count(*) as ne from ee group by all) using (x, y)")
def ego_pair(spark, sf_dir):
    pairs = vectors(spark, sf_dir).filter(F.col("id") % STEP == 0).select(F.col("id").alias("x"), (F.col("id") + 1).alias("y"))
    members, inside = topology.ego_pair(edges_of(spark, sf_dir), pairs)
    return topology.betti(members, inside, ("x", "y")).select("x", "y", "nv", "ne")


_RETRIEVE = f"""{EGO}, p as (select a.id as qid, b.id, a.v as q, b.v from e a join e b on a.id % {STEP} = 0 and a.id <> b.id), c as (select qid, id, q, v, row_number() over (partition by qid order by {L2}, id) as rn from p),
s as (select qid, id, 1 - (1 - {COS}) / 2 as score from c where rn <= {2 * K}), t as (select qid, id, score, 0.7 * (1 - score) + 0.3 * exp(-beta1 / greatest(ne, 1)::double) as d_total from s join st on ego = id)"""


@query(f"{_RETRIEVE} select qid, id, round(d_total, 6) as d_total, row_number() over (partition by qid order by d_total, id) as rank from t")
def rerank(spark, sf_dir):
    q, base = both(spark, sf_dir)
    near = cut(topk.top_k_bulk(q, base, 2 * K).join(base, "id").join(q, "qid").select("qid", "id", V.cosine_distance("q", "v", "half").alias("cosine")))
    stats = topology.ego_stats(edges_of(spark, sf_dir), near.select("id").distinct())
    return topology.rerank(near, stats).select("qid", "id", r6("d_total").alias("d_total"), F.col("d_rank").alias("rank"))


@query()
def rerank_pairwise(spark, sf_dir):
    base = vectors(spark, sf_dir).select("id", "v")
    q = query_batch(base)
    near = topk.top_k_bulk(q, base, 6).join(base, "id").join(q, "qid").select("qid", "id", V.cosine_distance("q", "v", "half").alias("cosine"))
    return topology.rerank_pairwise(cut(near), edges_of(spark, sf_dir)).select("qid", "id", r6("mean_d").alias("mean_d"))


@query(f"{EGO} select t1.ego, t1.u as a, t1.w as b, t2.w as c, round(greatest(t1.d, t2.d, t3.d), 6) as weight from ee t1 join ee t2 on t2.ego = t1.ego and t2.u = t1.w join ee t3 on t3.ego = t1.ego and t3.u = t1.u and t3.w = t2.w where t1.ego % {STEP} = 0")
def triangles(spark, sf_dir):
    base = vectors(spark, sf_dir)
    inside = topology.ego_single(edges_of(spark, sf_dir), base.filter(F.col("id") % STEP == 0).select("id"))[1]
    return topology.triangles(inside).withColumn("weight", r6("weight"))


@query()
def persistence(spark, sf_dir):
    edges = edges_of(spark, sf_dir)
    inside = topology.cap_edges(topology.ego_single(edges, edges.select("src").distinct())[1])
    return topology.persistence(inside).select("ego", "dim", r6("birth").alias("birth"), r6("death").alias("death"))


@query()
def d_total_persistence(spark, sf_dir):
    base = vectors(spark, sf_dir).select("id", "v")
    q = query_batch(base)
    near = cut(topk.top_k_bulk(q, base, K).join(base, "id").join(q, "qid").select("qid", "id", V.cosine_distance("q", "v", "half").alias("cosine")))
    inside = cut(topology.cap_edges(topology.ego_single(edges_of(spark, sf_dir), near.select("id").distinct())[1]))
    score = topology.diagram_stats(topology.persistence(inside)).select(F.col("ego").alias("id"), "score")
    ne = inside.groupBy(F.col("ego").alias("id")).agg(F.count(F.lit(1)).alias("ne"))
    df = near.join(score, "id", "left").join(ne, "id", "left").select("qid", "id", topology.d_total("cosine", F.coalesce("score", F.lit(0.0)), F.coalesce("ne", F.lit(0)), 0.7, 0.3).alias("d"))
    return df.select("qid", "id", r6("d").alias("d_total"))


def _stalks(spark, sf_dir) -> DataFrame:
    v = vectors(spark, sf_dir)
    halves = [v.select(F.col("id").alias("node"), F.lit(name).alias("modality"), F.slice("v", at, 32).alias("values")) for name, at in (("first", 1), ("second", 33))]
    return halves[0].unionByName(halves[1])


_SHEAF = f"{KNN}, s as (select id as node, list_transform(list_zip(v[1:32], v[33:64]), lambda z: (z[1] + z[2]) / 2) as x from e), o as (select src, dst, list_distance(a.x, b.x) ** 2 / (list_dot_product(a.x, a.x) + list_dot_product(b.x, b.x) + 1e-8) as obstruction from knn join s a on a.node = src join s b on b.node = dst)"


@query(f"{_SHEAF} select src, dst, round(obstruction, 6) as obstruction from o")
def sheaf_edges(spark, sf_dir):
    return topology.sheaf_edges(_stalks(spark, sf_dir), edges_of(spark, sf_dir)).select("src", "dst", r6("obstruction").alias("obstruction"))


@query(f"{_SHEAF} select count(*) as edge_count, round(avg(obstruction), 6) as h1, avg(obstruction) < 0.1 as is_consistent from o")
def sheaf_h1(spark, sf_dir):
    rows = topology.sheaf_edges(_stalks(spark, sf_dir), edges_of(spark, sf_dir))
    return topology.sheaf_h1(rows).select("edge_count", r6("h1").alias("h1"), "is_consistent")


@query(f"{E} select id as node, round(greatest(0.0, least(1.0, list_cosine_similarity(v[1:32], v[33:64]))), 6) as coherence from e")
def coherence(spark, sf_dir):
    return topology.coherence(_stalks(spark, sf_dir)).select("node", r6("coherence").alias("coherence"))


@query(f"{E} select id, round(2 * v[1] - v[2], 6) as x0, round(v[2] + 0.5 * v[3], 6) as x1 from e")
def restriction_map(spark, sf_dir):
    rows = rabitq.matrix([[2.0, -1.0, 0.0], [0.0, 1.0, 0.5]])
    return vectors(spark, sf_dir).select("id", topology.restrict("v", rows).alias("x")).select("id", r6(F.get("x", 0)).alias("x0"), r6(F.get("x", 1)).alias("x1"))


# ---- store
def _retrieved(df: DataFrame) -> DataFrame:
    return df.select("qid", "id", "rank", r6("score").alias("score"), r6("d_total").alias("d_total"))


def _items(base: DataFrame) -> DataFrame:
    meta = F.struct(F.lit(0).cast("long").alias("timestamp"), F.col("label").cast("string").alias("source"), F.array().cast("array<string>").alias("tags"), F.create_map().cast("map<string,string>").alias("extra"))
    return base.select(F.col("id").alias("seq"), F.col("v").alias("embedding"), meta.cast(METADATA).alias("metadata"))


def stored_vectors(spark: SparkSession, sf_dir: str, some: Column | None = None) -> store.VectorStore:
    """A new store with the table's vectors; ids are 0, 1, ... in the table and in the store."""
    base = vectors(spark, sf_dir)
    kept = store.VectorStore(spark, folder(spark, "store"), DIM, DEGREE)
    kept.ingest(_items(base if some is None else base.filter(some)))
    return kept


@query(f"{_RETRIEVE}, r as (select *, row_number() over (partition by qid order by score desc, id) as rank from s) select qid, id, rank, round(score, 6) as score, null::double as d_total from r where rank <= {K}")
def retrieve(spark, sf_dir):
    return _retrieved(store.retrieve(*both(spark, sf_dir), SearchConfig(K, enable_reranking=False)))


@query(f"{_RETRIEVE}, r as (select *, row_number() over (partition by qid order by d_total, id) as rank from t) select qid, id, rank, round(score, 6) as score, round(d_total, 6) as d_total from r where rank <= {K}")
def retrieve_rerank(spark, sf_dir):
    q, base = both(spark, sf_dir)
    config = SearchConfig(K, order_by="d_total")
    stats = topology.ego_stats(edges_of(spark, sf_dir), topk.top_k_bulk(q, base, config.candidates).select("id").distinct())
    return _retrieved(store.retrieve(q, base, config, stats))


@query(f"{E}, p as (select a.id as qid, b.id, a.v as q, b.v from e a join e b on a.id % {STEP} = 0 and a.id <> b.id and b.id % 10 <> 0), c as (select qid, id, q, v, row_number() over (partition by qid order by {L2}, id) as rn from p), s as (select qid, id, 1 - (1 - {COS}) / 2 as score from c where rn <= {2 * K}), r as (select *, row_number() over (partition by qid order by score desc, id) as rank from s) select qid, id, rank, round(score, 6) as score from r where rank <= {K}")
def vacuum_then_retrieve(spark, sf_dir):
    kept = stored_vectors(spark, sf_dir)
    kept.vacuum(kept.snapshot().filter("node_id % 10 = 0").select("node_id"))
    return _retrieved(kept.search(query_batch(vectors(spark, sf_dir)), SearchConfig(K, enable_reranking=False))).drop("d_total")


_LIVE = "e as (select vec_id as id, list_transform(embedding, lambda x: x::double) as v, label from embeddings where vec_id % 10 <> 0), a as (select vec_id as id, list_transform(embedding, lambda x: x::double) as v from embeddings)"
_LIVE_EGO = EGO.replace(E, _LIVE, 1)


@query(f"""{_LIVE_EGO}, p as (select a.id as qid, b.id, a.v as q, b.v from a join e b on a.id % {STEP} = 0 and a.id <> b.id), c as (select qid, id, q, v, row_number() over (partition by qid order by {L2}, id) as rn from p),
s as (select qid, id, 1 - (1 - {COS}) / 2 as score from c where rn <= {2 * K}), t as (select qid, id, score, 0.7 * (1 - score) + 0.3 * exp(-beta1 / greatest(ne, 1)::double) as d_total from s join st on ego = id),
r as (select *, row_number() over (partition by qid order by d_total, id) as rank from t) select qid, id, rank, round(score, 6) as score, round(d_total, 6) as d_total from r where rank <= {K}""")
def store_lifecycle(spark, sf_dir):
    """Two batches, a search that makes the kept graph, a vacuum, and a search by structure that takes over what hasn't changed."""
    base, config = vectors(spark, sf_dir), SearchConfig(K, order_by="d_total")
    n = base.count()
    kept = stored_vectors(spark, sf_dir, F.col("id") < n - n // 10)
    kept.graph()
    kept.ingest(_items(base.filter(F.col("id") >= n - n // 10)))
    kept.vacuum(kept.snapshot().filter("node_id % 10 = 0").select("node_id"))
    return _retrieved(kept.search(query_batch(base), config))


@query(f"{E}, n as (select count(*) as n, max(len(v)) as d from e) select n as total_nodes, d as dimensions, n * 9 * ceil(d / 8.0)::bigint as bitplane_coarse_bytes, n * (4 * d + 8 * 32 + 68) + n * 9 * ceil(d / 8.0)::bigint + 16 * n + 1024 as memory_usage_bytes, n * 16 * 2 * 8 + n * d * 4 + n * (d * 4 // 8 + 16) as combined_bytes from n")
def memory_model(spark, sf_dir):
    n, d = vectors(spark, sf_dir).agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    m = store.memory_model(n, d)
    return spark.createDataFrame([(n, d, m["bitplane_coarse_bytes"], m["memory_usage_bytes"], store.combined_memory(n, d)["total"])], "total_nodes long, dimensions long, bitplane_coarse_bytes long, memory_usage_bytes long, combined_bytes long")


@query(f"{E} select id, case when id % 7 = 0 then 'expected 64 dimensions, got 63' end as error from e")
def batch_ingest_check(spark, sf_dir):
    base = vectors(spark, sf_dir).withColumn("v", F.when(F.col("id") % 7 == 0, F.slice("v", 1, 63)).otherwise(F.col("v")))
    done = store.VectorStore(spark, folder(spark, "store"), DIM).ingest(_items(base))
    return done.select(F.col("seq").alias("id"), "error")


@query(f"{E} select id, label::bigint as label from e where id = 7")
def point_lookup(spark, sf_dir):
    row = stored_vectors(spark, sf_dir).get(7)
    return spark.createDataFrame([(row["node_id"], int(row["metadata"]["source"]))], "id long, label long")


@query(f"{E} select id, 'label ' || label as text, round(v[1], 6) as x0, len(v)::bigint as dim from e where id % 3 <> 0")
def jsonl_ingest(spark, sf_dir):
    v = vectors(spark, sf_dir)
    good = F.to_json(F.struct(F.concat(F.lit("label "), "label").alias("text"), F.col("v").alias("embedding"), "id"))
    lines = v.select("id", F.when(F.col("id") % 3 == 0, F.lit('{"text": "no vector"}')).otherwise(good).alias("value"))
    parsed = files.parse_lines(lines.select("value"), DIM)
    named = parsed.withColumn("x0", r6(F.get("embedding", 0).cast("double"))).withColumn("dim", F.size("embedding").cast("long"))
    ids = v.select("id", F.get("v", 0).alias("a"), F.get("v", 1).alias("b"))
    return named.join(ids, (F.get("embedding", 0) == F.col("a")) & (F.get("embedding", 1) == F.col("b"))).select("id", F.col("metadata.extra")["text"].alias("text"), "x0", "dim")


# ---- the kept index
CONFIG = IndexConfig(dimensions=DIM, max_neighbors=DEGREE)


def built(spark: SparkSession, sf_dir: str) -> index.CombinedIndex:
    made = index.CombinedIndex(spark, folder(spark, "index"), CONFIG)
    made.insert(vectors(spark, sf_dir).select("id", "v"))
    return made


_ALL = _rabitq_sql(4).replace(" and o.id <> g.id", "") + f", p as (select a.id as qid, b.id as id, a.v as q, b.v as v from e a join e b on a.id % {STEP} = 0), l2 as (select qid, id, {L2} as d from p)"


@query(f"{_ALL}, rk as (select l2.qid, l2.id, greatest(raw, 0) as est, d, row_number() over (partition by l2.qid order by d, l2.id) as rank from l2 join est using (qid, id)) select qid, id, rank, round(est, 6) as estimated, round(d, 6) as precise from rk where rank <= {K}")
def index_exact(spark, sf_dir):
    """The index without its graph; the query itself is found."""
    found = built(spark, sf_dir).search(query_batch(vectors(spark, sf_dir)), K, mode="exact")
    return found.select("qid", "id", "rank", r6("estimated").alias("estimated"), r6("precise").alias("precise"))


@query(f"{E}, l as (select {_LEVEL} as level from e), c as (select count(*) as n, count(*) filter (level = 0) as low from l) select low * 256 as freed_bytes, n * 16 * 2 * 8 as graph_bytes, (n - low) * 256 as float_bytes, n * 48 as code_bytes, n as nodes from c")
def index_compact(spark, sf_dir):
    made = built(spark, sf_dir)
    freed = made.compact()
    m = made.memory() | {"freed": freed, "nodes": len(made)}
    names = {"freed": "freed_bytes", "graph": "graph_bytes", "float": "float_bytes", "codes": "code_bytes", "nodes": "nodes"}
    return spark.range(1).select(*(F.lit(m[k]).cast("long").alias(name) for k, name in names.items()))  # without a Python worker


@query()
def index_recall(spark, sf_dir):
    """(setting, queries, recall) at 10 of the modes, and of the codes that are left when the index is compacted."""
    base = vectors(spark, sf_dir).select("id", "v")
    q, made = query_batch(base), built(spark, sf_dir)
    truth = cut(topk.top_k_bulk(q, base, K, exclude_self=False))
    found = {mode: cut(made.search(q, K, 64, mode)) for mode in ("asymmetric", "beam", "hybrid")}
    made.compact()
    found["compacted"] = cut(made.search(q, K, 64))
    return evaluate.recall_sweep(found, truth, K).withColumn("recall", r6("recall"))


@query()
def ef_sweep(spark, sf_dir):
    """(setting, queries, recall) at 10 of graph searches with growing beams."""
    base = vectors(spark, sf_dir).select("id", "v")
    q, edges = query_batch(base), cut(graph.build(base, DEGREE))
    truth = cut(topk.top_k_bulk(q, base, K, exclude_self=False))
    hubs = cut(topk.ranked(graph.hub_scores(edges), 8, "in_degree", "node", descending=True).select("node"))
    return evaluate.recall_sweep({f"ef {ef}": graph.beam_search(edges, base, q, hubs, ef) for ef in (16, 32, 64)}, truth, K).withColumn("recall", r6("recall"))


@query()
def index_insert(spark, sf_dir):
    """(layer, nodes, edges, most) of an index that took its last tenth of vectors by insertion, after some were removed."""
    base = vectors(spark, sf_dir).select("id", "v")
    n = base.count()
    made = index.CombinedIndex(spark, folder(spark, "index"), CONFIG)
    made.insert(base.filter(F.col("id") < n - n // 10))
    made.remove(base.filter("id % 10 = 3").select("id"))
    made.insert(base.filter(F.col("id") >= n - n // 10))
    degree = made.edges().groupBy("layer", "src").agg(F.count(F.lit(1)).alias("d"))
    return degree.groupBy("layer").agg(F.count(F.lit(1)).alias("nodes"), F.sum("d").alias("edges"), F.max("d").alias("most"))


# ---- evaluation and benchmark pipelines
_TRUTH = f"{P}, tr as (select qid, id, row_number() over (partition by qid order by {L2}, id) as rank from p), hm as (select qid, id, row_number() over (partition by qid order by {HAMMING}, id) as rank from p)"


@query(f"{_TRUTH} select q.qid, count(t.id) as hits, round(count(t.id) / {K}.0::double, 6) as recall from (select * from hm where rank <= {K}) q left join (select * from tr where rank <= {K}) t using (qid, id) group by 1")
def bench_naive_binary(spark, sf_dir):
    q, base = both(spark, sf_dir)
    found, truth = topk.hamming_top_k(*_coded(spark, sf_dir), K), topk.top_k_bulk(q, base, K)
    return evaluate.recall_at_k(found, truth, K).select("qid", "hits", r6("recall").alias("recall"))


def _rabitq_recall(bits: int) -> Callable:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = _estimated_top(spark, sf_dir, bits)
        return evaluate.recall_at_k(found, topk.top_k_bulk(*both(spark, sf_dir), K), K).select("qid", "hits", r6("recall").alias("recall"))

    run.__name__ = f"bench_rabitq_brute_{bits}bit"
    return query(f"{_rabitq_sql(bits)}, {_PAIR}, tr as (select qid, id, row_number() over (partition by qid order by d, id) as rank from l2), fo as (select qid, id, row_number() over (partition by qid order by greatest(raw, 0), id) as rank from est) select q.qid, count(t.id) as hits, round(count(t.id) / {K}.0::double, 6) as recall from (select * from fo where rank <= {K}) q left join (select * from tr where rank <= {K}) t using (qid, id) group by 1")(run)


for _bits in (1, 4):
    _rabitq_recall(_bits)


@query(f"{_rabitq_sql(4)}, {_PAIR}, s as (select qid, id, row_number() over (partition by qid order by greatest(raw, 0), id) as rn from est), rk as (select s.qid, s.id, row_number() over (partition by s.qid order by d, s.id) as rank from s join l2 using (qid, id) where rn <= {5 * K}), tr as (select qid, id, row_number() over (partition by qid order by d, id) as rank from l2) select t.qid, count(f.id) as hits, round(count(f.id) / {K}.0::double, 6) as recall from (select * from tr where rank <= {K}) t left join (select * from rk where rank <= {K}) f using (qid, id) group by 1")
def bench_combined_two_phase(spark, sf_dir):
    q, base = both(spark, sf_dir)
    found = topk.two_phase(_estimated_top(spark, sf_dir, 4, 5 * K), base, q, K)
    return evaluate.recall_at_k(found, topk.top_k_bulk(q, base, K), K).select("qid", "hits", r6("recall").alias("recall"))


@query(f"{_TRUTH} select t.qid, coalesce(round(1 / min(h.rank)::double, 6), 0) as mrr from (select * from tr where rank <= {K}) t left join (select * from hm where rank <= {K}) h using (qid, id) group by 1")
def mrr_at_k(spark, sf_dir):
    q, base = both(spark, sf_dir)
    found, truth = topk.hamming_top_k(*_coded(spark, sf_dir), K), topk.top_k_bulk(q, base, K)
    return evaluate.mrr_at_k(found, truth, K).select("qid", r6("mrr").alias("mrr"))


@query("v as (select value, row_number() over (order by value) - 1 as i, count(*) over () as n from events), p as (select unnest([50, 95, 99]) as percent) select percent::bigint as percent, value from v join p on i = least(n * percent // 100, n - 1)")
def latency_percentile(spark, sf_dir):
    return evaluate.percentile(spark.read.parquet(f"{sf_dir.rstrip('/')}/events.parquet"), "value", [50, 95, 99])


@query("s as (select user_id, lag(user_id) over (order by event_id) as prev from events), c as (select prev, user_id as next, count(*) as n from s where prev is not null group by all) select prev, next, round(1 - pow(0.9::double, n), 6) as weight, row_number() over (partition by prev order by n desc, next) = 1 as is_best from c")
def access_predictor(spark, sf_dir):
    log = spark.read.parquet(f"{sf_dir.rstrip('/')}/events.parquet").select(F.col("event_id").alias("seq"), F.col("user_id").alias("id"))
    return store.access_predictor(log).withColumn("weight", r6("weight"))
