"""Float bit planes: sign and exponent coarsely, the mantissa by degrees."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.plans.cutting import cut
from plumbline.plans.tables import Versions

MANTISSA = 23
COARSE = 9


def _exponent(x: Column) -> Column:
    """floor(log2(|x|)), set right where the logarithm rounds across a power of 2."""
    a = F.abs(x)
    e = F.floor(F.log2(a)).cast("int")
    e = F.when(F.pow(F.lit(2.0), e) > a, e - 1).otherwise(e)
    return F.when(F.pow(F.lit(2.0), e + 1) <= a, e + 1).otherwise(e)


def coarse(v: Column | str) -> Column:
    """Values of sign and exponent only; 0 and denormals are 0."""
    v = F.col(v) if isinstance(v, str) else v
    return F.transform(v, lambda x: F.when(F.abs(x) < 2.0**-126, F.lit(0.0)).otherwise(F.signum(x.cast("double")) * F.pow(F.lit(2.0), _exponent(x.cast("double")))))


def partial(v: Column | str, bits: int, msb: bool = False) -> Column:
    """Values of sign, exponent and ``bits`` mantissa bits: the lowest ones, or with ``msb`` the highest. Normal numbers and 0."""
    v, n = F.col(v) if isinstance(v, str) else v, max(0, min(bits, MANTISSA))
    step = 2 ** (MANTISSA - n if msb else n)

    def one(x: Column) -> Column:
        x = x.cast("double")
        low = F.pow(F.lit(2.0), _exponent(x))
        m = F.round((F.abs(x) / low - 1) * 2.0**MANTISSA).cast("long")
        kept = m - m % step if msb else m % step
        return F.when(F.abs(x) < 2.0**-126, F.lit(0.0)).otherwise(F.signum(x) * low * (1 + kept / 2.0**MANTISSA))

    return F.transform(v, one)


def decompose(df: DataFrame, id_col: str = "id", v: str = "v") -> DataFrame:
    """(id, sign, exponent, mantissa): planes as bytes, bit d % 8 of byte d / 8 for dimension d; plane k holds bit k of its field. Vectors of one length in a batch
    are taken together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = pa.list_(pa.binary())
        for batch in batches:
            rows = [np.array(x or [], np.float32) for x in batch.column(1).to_pylist()]
            out: list[tuple] = [()] * len(rows)
            for dim in {len(r) for r in rows}:
                at = [i for i, r in enumerate(rows) if len(r) == dim]
                words = np.stack([rows[i] for i in at]).view(np.uint32)
                bits = np.packbits((words[:, None, :] >> np.arange(32, dtype=np.uint32)[None, :, None] & 1).astype(bool), axis=2, bitorder="little")
                for i, packed in zip(at, bits, strict=True):
                    each = [p.tobytes() for p in packed]
                    out[i] = each[31], each[MANTISSA:31], each[:MANTISSA]
            columns = [pa.array([x[i] for x in out], kind) for i, kind in enumerate((pa.binary(), planes, planes))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["id", "sign", "exponent", "mantissa"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), v).mapInArrow(run, f"id {kind}, sign binary, exponent array<binary>, mantissa array<binary>")


def reconstruct(planes: DataFrame, dim: int, bits: int = MANTISSA, msb: bool = False) -> DataFrame:
    """(id, v) from decompose's planes, reading the first ``bits`` mantissa planes (or the last, with ``msb``). Without a mantissa the values are coarse."""
    n = max(0, min(bits, MANTISSA))
    read = F.slice("mantissa", MANTISSA - n + 1, n) if msb else F.slice("mantissa", 1, n)
    read = F.coalesce(read, F.array().cast("array<binary>"))
    first = MANTISSA - n if msb else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = -(-dim // 8)
        for batch in batches:
            words = np.zeros((batch.num_rows, dim), np.uint32)

            def add(column: list[bytes], place: int, at: np.ndarray, words: np.ndarray = words) -> None:
                raw = np.frombuffer(b"".join(column), np.uint8).reshape(len(column), width)
                words[at] |= np.unpackbits(raw, axis=1, bitorder="little")[:, :dim].astype(np.uint32) << np.uint32(place)

            every = np.arange(batch.num_rows)
            add(batch.column(1).to_pylist(), 31, every)
            exponent, mantissa = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            for k in range(8):
                add([e[k] for e in exponent], MANTISSA + k, every)
            for k in range(max(map(len, mantissa), default=0)):
                add([m[k] for m in mantissa if len(m) > k], first + k, np.array([i for i, m in enumerate(mantissa) if len(m) > k], int))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(words.view(np.float32)), pa.list_(pa.float32()))], names=["id", "v"])

    kind = planes.schema["id"].dataType.simpleString()
    return planes.select("id", "sign", "exponent", read.alias("mantissa")).mapInArrow(run, f"id {kind}, v array<float>")


class BitPlaneStore:
    """Vectors as bit planes in two tiers, a folder of coarse planes (sign, exponent) and one of mantissas, so that a coarse read opens the first alone."""

    def __init__(self, spark: SparkSession, folder: str, dimensions: int):
        self.spark, self.dimensions, self.kept = spark, dimensions, Versions(spark, folder)

    def _tier(self, name: str) -> DataFrame:
        return self.kept.read(name, "id long, sign binary, exponent array<binary>" if name == "coarse" else "id long, mantissa array<binary>")

    def insert(self, vectors: DataFrame) -> DataFrame:
        """Stores vectors (id, v); one whose id is known replaces it. Gives (id, error): null, or what is wrong with the vector, which then isn't stored."""
        n = F.coalesce(F.size("v"), F.lit(0))
        checked = cut(vectors.select(F.col("id").cast("long").alias("id"), "v").withColumn("error", F.when(n != self.dimensions, F.concat(F.lit(f"expected {self.dimensions} dimensions, got "), n))))
        new = cut(decompose(checked.filter("error is null")))
        keep = {t: self._tier(t).join(new.select("id"), "id", "left_anti") for t in ("coarse", "mantissa")}
        self.kept.write({"coarse": keep["coarse"].unionByName(new.drop("mantissa")), "mantissa": keep["mantissa"].unionByName(new.select("id", "mantissa"))})
        return checked.select("id", "error")

    def delete(self, ids: DataFrame) -> DataFrame:
        """Removes ids (one column) from both tiers. Gives (id, deleted): whether either tier had it."""
        gone = cut(ids.select(F.col(ids.columns[0]).cast("long").alias("id")).distinct())
        had = cut(gone.join(self._tier("coarse").select("id").unionByName(self._tier("mantissa").select("id")).distinct().withColumn("deleted", F.lit(True)), "id", "left").select("id", F.coalesce("deleted", F.lit(False)).alias("deleted")))
        self.kept.write({t: self._tier(t).join(gone, "id", "left_anti") for t in ("coarse", "mantissa")})
        return had

    def read(self, bits: int = MANTISSA, msb: bool = False) -> DataFrame:
        """(id, v) with ``bits`` mantissa bits; with none, the mantissas aren't read."""
        coarse_tier = self._tier("coarse")
        planes = coarse_tier.withColumn("mantissa", F.lit(None).cast("array<binary>")) if bits <= 0 else coarse_tier.join(self._tier("mantissa"), "id", "left")
        return reconstruct(planes, self.dimensions, bits, msb)


def sizes(dim: int, bits: int = MANTISSA) -> dict[str, float]:
    """Bytes of the coarse and of all planes, and what reading ``bits`` mantissa planes costs of the floats' bytes."""
    plane = math.ceil(dim / 8)
    return {"coarse": COARSE * plane, "total": 32 * plane, "ratio": (COARSE + min(bits, MANTISSA)) * plane / (4 * dim)}


def confidence(bits: Column) -> Column:
    return bits / F.lit(float(MANTISSA))


def precision_name(level: Column, bits: Column) -> Column:
    """How a level reads: coarse, partial with its bits, or full."""
    return F.when(level == "coarse", "Coarse (0 bits)").when(level == "full", "Full (23 bits)").otherwise(F.concat(F.lit("Partial ("), bits.cast("string"), F.lit(" bits)")))


def meets(level: Column, bits: Column, required_level: Column, required_bits: Column) -> Column:
    """Whether a precision is at least another: coarse, then partial by its bits, then full, which is above partial with all bits."""
    order = lambda lv, b: F.when(lv == "coarse", -1).when(lv == "full", MANTISSA + 1).otherwise(b)
    return order(level, bits) >= order(required_level, required_bits)
