"""Vector kernels on matrices of doubles: every row of q with every row of v, as a matrix. They give what the expressions in vectors.py give."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from plumbline.functions.vectors import ZERO

Kernel = Callable[[np.ndarray, np.ndarray], np.ndarray]


def by_length(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """The places and the matrix of an array column's vectors of each length. Null vectors and those that hold a null are left out."""
    sizes = np.array(pc.list_value_length(column).fill_null(-1))
    if column.flatten().null_count:
        sizes[np.asarray(pc.list_parent_indices(column))[np.asarray(column.flatten().is_null())]] = -1
    out = {}
    for n in np.unique(sizes[sizes >= 0]):
        at = np.flatnonzero(sizes == n)
        part = column if len(at) == len(column) else column.take(pa.array(at))
        out[int(n)] = at, np.asarray(part.flatten(), float).reshape(len(at), int(n))
    return out


def rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """Rounded half away from zero; no result is a negative zero."""
    with np.errstate(over="ignore", invalid="ignore"):
        r = np.copysign(np.floor(np.abs(x) * 10.0**digits + 0.5), x) / 10.0**digits
    return np.where(np.isfinite(r), r, x) + 0.0


def dot(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    return q @ v.T


def l2_sq(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """By differences, so that large vectors near each other lose no digits."""
    out = np.empty((len(q), len(v)))
    for k, x in enumerate(q):
        d = v - x
        out[k] = np.einsum("ij,ij->i", d, d)
    return out


def _cosine(q: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    product = np.sqrt((q * q).sum(1))[:, None] * np.sqrt((v * v).sum(1))[None]
    with np.errstate(divide="ignore", invalid="ignore"):
        return product, q @ v.T / product


def _clamp(x: np.ndarray, low: float, high: float) -> np.ndarray:
    return np.fmax(low, np.fmin(high, x))  # a NaN counts as the greatest, as in expressions


def cosine_similarity(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    product, c = _cosine(q, v)
    return np.where(product <= 0, 0.0, _clamp(c, -1, 1))


def cosine_distance(convention: str = "unit") -> Kernel:
    def run(q: np.ndarray, v: np.ndarray) -> np.ndarray:
        product, c = _cosine(q, v)
        far = _clamp((1 - c) / 2, 0, 1) if convention == "half" else 1 - _clamp(c, -1, 1)
        return np.where(product <= 0, ZERO[convention], far)

    return run


def bulk_cosine_distance(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    product, c = _cosine(q, v)
    return np.where(product < 1e-10, 2.0, 1 - c)


def sheaf_cosine(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    product, c = _cosine(q, v)
    return np.where(product <= 0, 1.0, _clamp(c, 0, 1))


def retrieval_score(mode: str = "cosine") -> Kernel:
    far = cosine_distance("half")
    return lambda q, v: 1 / (1 + l2_sq(q, v)) if mode == "l2" else 1 - far(q, v)


def hamming(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Differing bits of the codes of sign_bits()."""
    a, b = (q > 0).astype(float), (v > 0).astype(float)
    return a.sum(1)[:, None] + b.sum(1)[None] - 2 * a @ b.T
