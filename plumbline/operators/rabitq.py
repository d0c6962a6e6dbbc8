"""Randomised multi-bit quantisation with asymmetric distance estimates.

A residual from the centroid is normalised, turned by a fixed random rotation and
rounded to a few bits per dimension; the estimate of a squared distance needs the
code, three factors per vector and the rotated query. The rotation is one matrix,
folded into the plan as a literal, so encoding and estimating stay in the JVM.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import vectors as V
from plumbline.operators.topk import Distances, in_passes, matrix_of, top_k_by
from plumbline.schema import CompressionError

SEED, ROUNDS = 42, 3
#: Codes step by a tenth of a normalised coordinate, whatever their bits.
STEPS = 10.0


def hadamard(n: int) -> np.ndarray:
    """The n x n matrix of the unnormalised fast Hadamard transform; n is a power of 2."""
    h = np.ones((1, 1))
    while len(h) < n:
        h = np.kron(np.array([[1.0, 1.0], [1.0, -1.0]]), h)
    return h


def fast_hadamard(x: np.ndarray) -> np.ndarray:
    """hadamard(n) @ x along the first axis, by halving: n log n additions."""
    x, width = x.copy(), 1
    while width < len(x):
        y = x.reshape(-1, 2, width, *x.shape[1:])
        x = np.stack([y[:, 0] + y[:, 1], y[:, 0] - y[:, 1]], 1).reshape(x.shape)
        width *= 2
    return x


def rotation(dim: int, seed: int = SEED, rounds: int = ROUNDS) -> list[list[float]]:
    """Rounds of seeded sign flips and normalised Hadamard transforms as one matrix, padded to a power of 2 and cut back to dim."""
    padded = 1 << max(0, dim - 1).bit_length()
    rng, m = np.random.default_rng(seed), np.eye(padded)
    for _ in range(rounds):
        m = fast_hadamard(rng.choice([-1.0, 1.0], padded)[:, None] * m) / math.sqrt(padded)
    return m[:dim, :dim].tolist()


def matrix(m: list[list[float]]) -> Column:
    """A constant matrix."""
    return F.from_json(F.lit(json.dumps(m)), "array<array<double>>")


def rotate(v: Column | str, m: list[list[float]]) -> Column:
    v = F.col(v) if isinstance(v, str) else v
    return V.let(v, lambda u: F.transform(matrix(m), lambda row: V.dot(row, u)))


def centroid(vectors: DataFrame, v: str = "v") -> DataFrame:
    """One row with the mean vector c; none if there are no vectors."""
    means = vectors.select(F.posexplode(v).alias("pos", "x")).groupBy("pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    one = means.agg(F.array_sort(F.collect_list(F.struct("pos", "m"))).alias("a"))  # a row per dimension
    return one.filter(F.size("a") > 0).select(F.transform("a", lambda x: x["m"]).alias("c"))


def _half(bits: int) -> float:
    if bits not in (1, 4, 7):
        raise CompressionError(f"codes have 1, 4 or 7 bits, not {bits}")
    return (2**bits - 1) / 2


def reconstructed(code: Column | str, bits: int) -> Column:
    """The values that a code stands for, from -1 to 1."""
    h, code = _half(bits), F.col(code) if isinstance(code, str) else code
    return F.transform(code, lambda q: 2.0 * q - 1.0 if bits == 1 else (q - h) / h)


def encode(vectors: DataFrame, center: DataFrame, m: list[list[float]], bits: int = 4, residual_least: float = 1e-10) -> DataFrame:
    """(id, code, sqr_norm, norm, x0, error_bound) from (id, v); center is one row."""
    h, dim = _half(bits), len(m)
    df = vectors.select("id", "v").crossJoin(F.broadcast(center.limit(1)))
    df = df.withColumn("r", F.zip_with("v", "c", lambda x, c: x.cast("double") - c)).withColumn("sqr_norm", V.dot("r", "r")).withColumn("norm", F.sqrt("sqr_norm"))
    df = df.withColumn("x", rotate(V.normalize("r", residual_least), m))
    if bits == 1:
        df = df.withColumn("code", F.transform("x", lambda x: (x > 0).cast("int")))
    else:
        df = df.withColumn("code", F.transform("x", lambda x: F.least(F.round(F.greatest(F.lit(-h), F.least(F.lit(h), x * STEPS)) + h), F.lit(2.0**bits - 1)).cast("int")))
    x0 = V.dot(reconstructed("code", bits), "x") / math.sqrt(dim)
    df = df.withColumn("x0", F.when(x0 <= 1e-6, 0.8).otherwise(x0))
    spread = F.sqrt(F.greatest(1 / (F.col("x0") * F.col("x0")) - 1, F.lit(0.0))) / math.sqrt(max(dim - 1, 1))
    return df.select("id", "code", "sqr_norm", "norm", "x0", (2 * 1.9 * F.col("norm") * spread).alias("error_bound"))


def encode_rows(rows: DataFrame, center: DataFrame, m: list[list[float]], bits: int = 4, residual_least: float = 1e-10) -> DataFrame:
    """Rows (id, v, ...) of vectors of one length, as many numbers as the rotation has, with what encode() gives for them as further columns: by matrices, many
    rows at once, but with its sums in the same order, so that all bits are the same."""
    h, dim = _half(bits), len(m)
    one = center.first()
    if one is None or len(one["c"]) != dim or any(x is None for x in one["c"]):  # no row has all numbers
        return rows.join(encode(rows, center, m, bits, residual_least), "id")
    c, turn, at = np.array(one["c"], float), np.array(m).T, rows.columns.index("v")
    added = "code array<int>, sqr_norm double, norm double, x0 double, error_bound double"

    def dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        total = np.zeros(len(a))
        for j in range(dim):
            total += a[:, j] * b[:, j]
        return total

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 512):
                batch = whole.slice(lo, 512)
                n, flat = batch.num_rows, batch.column(at).flatten()
                r = np.asarray(flat.fill_null(0.0), float).reshape(n, dim) - c
                lacks = ~np.asarray(flat.is_valid()).reshape(n, dim).all(1) if flat.null_count else np.zeros(n, bool)
                with np.errstate(all="ignore"):
                    sqr = dot(r, r)
                    norm = np.sqrt(sqr)
                    u = np.where(((norm <= residual_least) | lacks)[:, None], 0.0, r / norm[:, None])
                    x = np.zeros((n, dim))
                    for j in range(dim):
                        x += u[:, j, None] * turn[j]
                    if bits == 1:
                        code = ((x > 0) | np.isnan(x)).astype(np.int32)  # Spark's NaN is above all numbers
                    else:
                        y = np.fmax(-h, np.fmin(h, x * STEPS)) + h
                        whole_part = np.floor(y)
                        code = np.minimum(whole_part + (y - whole_part >= 0.5), 2.0**bits - 1).astype(np.int32)
                    x0 = dot(values_of(code.astype(float), bits), x) / math.sqrt(dim)
                    x0 = np.where(x0 <= 1e-6, 0.8, x0)
                    spread = np.sqrt(np.maximum(1 / (x0 * x0) - 1, 0.0)) / math.sqrt(max(dim - 1, 1))
                    bound = 2 * 1.9 * norm * spread
                codes = pa.ListArray.from_arrays(pa.array(np.arange(0, n * dim + 1, dim, dtype=np.int32)), pa.array(code.ravel()))
                columns = [codes, *(pa.array(f, mask=mask) for f, mask in ((sqr, lacks), (norm, lacks), (x0, None), (bound, lacks)))]
                yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, "code", "sqr_norm", "norm", "x0", "error_bound"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{kinds}, {added}")


def encode_queries(queries: DataFrame, center: DataFrame, m: list[list[float]], *kept: str) -> DataFrame:
    """(qid, y, sqr_y, q_norm) from (qid, q): residuals are rotated as they are. kept: columns to keep, after qid."""
    df = queries.select("qid", "q").crossJoin(F.broadcast(center.limit(1))).withColumn("r", F.zip_with("q", "c", lambda x, c: x.cast("double") - c))
    return df.select("qid", *kept, rotate("r", m).alias("y"), V.dot("r", "r").alias("sqr_y")).withColumn("q_norm", F.sqrt("sqr_y"))


def raw_estimate(dim: int) -> Column:
    """The raw estimate, over columns of a code with its values (recon) and of an encoded query."""
    return F.col("sqr_norm") + F.col("sqr_y") - 2 * F.col("norm") / (F.col("x0") * math.sqrt(dim)) * V.dot("recon", "y")


def _scored(df: DataFrame, dim: int) -> DataFrame:
    df = df.select("qid", "id", raw_estimate(dim).alias("raw"), (F.col("error_bound") * F.col("q_norm")).alias("off"))
    return df.select("qid", "id", F.greatest("raw", F.lit(0.0)).alias("estimate"), (F.col("raw") - F.col("off")).alias("lower_bound"))


def estimates(codes: DataFrame, queries: DataFrame, bits: int, dim: int, exclude_self: bool = True) -> DataFrame:
    """(qid, id, estimate, lower_bound) of every encoded query and code, whose values are made once; the query batch is the broadcast side, in passes of a
    checked size."""
    rows, out = codes.withColumn("recon", reconstructed("code", bits)).drop("code"), None
    for part in in_passes(queries, 8 * F.size("y") + 40):
        df = F.broadcast(part).crossJoin(rows)
        df = _scored(df.filter(F.col("qid") != F.col("id")) if exclude_self else df, dim)
        out = df if out is None else out.unionByName(df)
    return out


def estimates_of(pairs: DataFrame, codes: DataFrame, queries: DataFrame, bits: int, dim: int) -> DataFrame:
    """(qid, id, estimate, lower_bound) of given pairs (qid, id) only."""
    rows = codes.withColumn("recon", reconstructed("code", bits)).drop("code")
    return _scored(pairs.select("qid", "id").join(rows, "id").join(queries, "qid"), dim)


class Estimates(Distances):
    """Estimates of encoded queries (y, then sqr_y) to codes, for top_k_by."""

    def __init__(self, bits: int, dim: int):
        self.bits, self.dim = bits, dim
        _half(bits)

    def rows(self, batch: pa.RecordBatch) -> tuple:
        values = values_of(matrix_of(batch.column(1), batch.num_rows), self.bits)
        sqr, norm, x0 = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3, 4))
        return values, sqr, 2 * norm / (x0 * math.sqrt(self.dim))

    def least(self, q: np.ndarray, rows: tuple) -> None:
        return None

    def near(self, q: np.ndarray, rows: tuple) -> np.ndarray:
        values, sqr, factor = rows
        return np.maximum(q[:, -1:] + sqr[None] - factor[None] * (q[:, :-1] @ values.T), 0.0)

    def slack(self, q: np.ndarray, rows: tuple) -> np.ndarray:
        return 1e-11 * (1 + q[:, -1] + rows[1].max(initial=0.0))

    def exact(self, q: np.ndarray, rows: tuple, at: np.ndarray, of: np.ndarray) -> np.ndarray:
        values, sqr, factor = rows
        return np.maximum(q[at, -1] + sqr[of] - factor[of] * (q[at, :-1] * values[of]).sum(1), 0.0)


def estimated_top_k(codes: DataFrame, queries: DataFrame, k: int, bits: int, dim: int, exclude_self: bool = True) -> DataFrame:
    """(qid, id, estimate, rank): the k codes with the least estimates, by matrix products; queries as encode_queries gives them."""
    q = queries.select("qid", F.concat("y", F.array("sqr_y")).alias("q"))
    rows = codes.select("id", "code", "sqr_norm", "norm", "x0")
    return top_k_by(q, rows, k, Estimates(bits, dim), exclude_self).withColumnRenamed("distance", "estimate")


def values_of(code: np.ndarray, bits: int) -> np.ndarray:
    """reconstructed(), of a matrix of codes."""
    half = _half(bits)
    return 2.0 * code - 1.0 if bits == 1 else (code - half) / half


def planes(code: Column | str, bits: int) -> Column:
    """A code as bit planes of 64-bit words, plane after plane."""
    code = F.col(code) if isinstance(code, str) else code
    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(bits - 1)), lambda k: V.sign_bits(F.transform(code, lambda q: F.call_function("shiftright", q, k).bitwiseAND(1)))))
