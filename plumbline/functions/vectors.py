"""Vector kernels as Catalyst expressions.

Vectors are array<float> columns; all arithmetic is in double precision. Every
function takes and gives columns and stays in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def _d(x: Column) -> Column:
    return x.cast("double")


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def _clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, body) -> Column:
    """body(value), where the value is computed once however often the body uses it, in lambdas too."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def dot(a: Column | str, b: Column | str) -> Column:
    """Sum of products."""
    return _sum(F.zip_with(_col(a), _col(b), lambda x, y: _d(x) * _d(y)))


def l2_sq(a: Column | str, b: Column | str) -> Column:
    """Squared Euclidean distance."""
    return _sum(F.zip_with(_col(a), _col(b), lambda x, y: (_d(x) - _d(y)) * (_d(x) - _d(y))))


def norm(a: Column | str) -> Column:
    """Euclidean norm."""
    return F.sqrt(dot(a, a))


def normalize(a: Column | str, least: float = 0.0) -> Column:
    """a / norm(a); a zero vector where the norm isn't above ``least``."""
    return let(norm(a), lambda n: F.transform(_col(a), lambda x: F.when(n > least, _d(x) / n).otherwise(F.lit(0.0))))


def _cosine(a: Column | str, b: Column | str) -> tuple[Column, Column]:
    product = norm(a) * norm(b)
    return product, dot(a, b) / product


#: What a distance is where a vector is zero, by convention.
ZERO = {"unit": 1.0, "graph": 2.0, "half": 1.0}


def cosine_similarity(a: Column | str, b: Column | str) -> Column:
    """Clamped to [-1, 1]; 0 for a zero vector."""
    product, c = _cosine(a, b)
    return F.when(product > 0, _clamp(c, -1.0, 1.0)).otherwise(F.lit(0.0))


def cosine_distance(a: Column | str, b: Column | str, convention: str = "unit") -> Column:
    """``unit``: 1 - cos in [0, 2], 1 for a zero vector. ``graph``: the same, 2 for a zero vector. ``half``: (1 - cos) / 2 in [0, 1], 1 for a zero vector."""
    product, c = _cosine(a, b)
    far = _clamp((1 - c) / 2, 0.0, 1.0) if convention == "half" else 1 - _clamp(c, -1.0, 1.0)
    return F.when(product > 0, far).otherwise(F.lit(ZERO[convention]))


def bulk_cosine_distance(a: Column | str, b: Column | str) -> Column:
    """1 - cos without clamping, as batch kernels give it; 2 where the product of the norms is below 1e-10."""
    product, c = _cosine(a, b)
    return F.when(product >= 1e-10, 1 - c).otherwise(F.lit(2.0))


def sheaf_cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine of the common length, clamped to [0, 1]; 1 for an empty or zero vector."""
    a, b = _col(a), _col(b)
    n = F.least(F.size(a), F.size(b))
    a, b = F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n)
    product, c = _cosine(a, b)
    return F.when((n > 0) & (product > 0), _clamp(c, 0.0, 1.0)).otherwise(F.lit(1.0))


def retrieval_score(a: Column | str, b: Column | str, mode: str = "cosine") -> Column:
    """``cosine``: 1 - half cosine distance. ``l2``: 1 / (1 + squared distance)."""
    return 1 / (1 + l2_sq(a, b)) if mode == "l2" else 1 - cosine_distance(a, b, "half")


def sign_bits(a: Column | str, word: int = 64, zero_is_set: bool = False) -> Column:
    """Sign bits in words of ``word`` bits, the lowest bit first. Set bits are values above 0, or 0 and above."""
    a = _col(a)
    words = F.sequence(F.lit(0), F.ceil(F.size(a) / F.lit(word)).cast("int") - 1)

    def bit(x: Column, i: Column) -> Column:
        return F.when(x >= 0 if zero_is_set else x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))

    def one(k: Column) -> Column:
        return F.aggregate(F.transform(F.slice(a, k * word + 1, F.lit(word)), bit), F.lit(0).cast("long"), lambda s, x: s.bitwiseOR(x))

    return F.transform(words, one)


def hamming(a: Column | str, b: Column | str) -> Column:
    """Differing bits of two codes."""
    return F.aggregate(F.zip_with(_col(a), _col(b), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def projection(a: Column | str, plane: list[float]) -> Column:
    """The product with a fixed vector, as a key of locality."""
    return dot(a, F.array(*map(F.lit, plane)))


def preview(extra: Column | str, source: Column | str, chars: int = 72) -> Column:
    """The first characters of the entry text, or of the source where there is none."""
    return F.substring(F.coalesce(F.try_element_at(_col(extra), F.lit("text")), _col(source)), 1, chars)


def register(spark: SparkSession) -> None:
    """Temporary SQL functions, which are inlined into plans: vec_dot, vec_l2_sq, vec_norm, vec_cosine_distance, vec_hamming."""
    a, b = "a array<float>", "b array<float>"
    dots = "aggregate(zip_with({x}, {y}, (p, q) -> double(p) * double(q)), 0D, (s, p) -> s + p)"
    spark.sql(f"create or replace temporary function vec_dot({a}, {b}) returns double return {dots.format(x='a', y='b')}")
    spark.sql(f"create or replace temporary function vec_norm({a}) returns double return sqrt({dots.format(x='a', y='a')})")
    spark.sql(f"create or replace temporary function vec_l2_sq({a}, {b}) returns double return aggregate(zip_with(a, b, (p, q) -> (double(p) - double(q)) * (double(p) - double(q))), 0D, (s, p) -> s + p)")
    spark.sql(f"create or replace temporary function vec_cosine_distance({a}, {b}) returns double return case when vec_norm(a) * vec_norm(b) > 0 then 1 - greatest(-1D, least(1D, vec_dot(a, b) / (vec_norm(a) * vec_norm(b)))) else 1D end")
    spark.sql("create or replace temporary function vec_hamming(a array<bigint>, b array<bigint>) returns int return aggregate(zip_with(a, b, (p, q) -> bit_count(p ^ q)), 0, (s, p) -> s + p)")
