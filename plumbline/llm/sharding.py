"""Operator 8: sharding by histogram sort, in DataFrame functions only.

Rows are sorted by the hash of their text, then of their id, so equal texts stand
together. The splitters between shards are found by counting exact bytes below
candidate keys: every round counts, over all partitions, the bytes of equal
intervals of the key space inside which splitters lie, and moves each splitter to
the interval's edge nearest to its target; a splitter that isn't within the
tolerance is refined inside its interval, unless that holds a single row. The driver sees at most
``shards * 2 ** bits`` sums a round. Then the rows are exchanged once, into many
small buckets of each shard, where they get their slots.

Law: ``bytes``; the shards' sizes are near equal. Groups of equal texts stay whole
unless a splitter can only meet its tolerance inside one, as it must for a group
larger than a shard.

Defined results: a null text has size 1 and text_crc32 0, as an empty one. Equal
rows are told apart by nothing and may share any slots. An empty table gives an
empty table; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stored

SHARDS = 16
#: A splitter may be off by this share of a shard's bytes.
TOLERANCE = 0.01
#: Each round tells 2 ** BITS intervals of every open interval apart.
BITS = 8
#: Rows of a shard are dealt to so many buckets when they get their slots.
BUCKETS = 256
_WORD = 64


def _digit(level: int, bits: int) -> Column:
    """Digit ``level`` of the 128-bit key (k1, k2), the first being the highest."""
    at = level * bits
    return F.shiftrightunsigned(F.shiftleft(F.col("k1" if at < _WORD else "k2"), at % _WORD), _WORD - bits).cast("int")


def find_splitters(keyed: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE, bits: int = BITS) -> tuple[list[tuple[int, ...]], int]:
    """The splitters as lists of digits, ascending, and the number of rounds; rows whose digits aren't below splitter i are in shard i + 1 or later."""
    levels = 2 * _WORD // bits
    splitters: list[tuple[int, ...]] = []
    total = 0
    open_at: dict[tuple[int, ...], tuple[float, list[tuple[int, float]]]] = {}
    for level in range(levels):
        rows = keyed.withColumn("d", _digit(level, bits))
        if level:
            spots = [list(p) for p in open_at]
            known = F.array(*(_digit(i, bits) for i in range(level)))
            rows = rows.withColumn("p", known).filter(F.col("p").isin([F.array(*map(F.lit, s)) for s in spots]))
            sums = rows.groupBy("p", "d").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n"))
        else:
            sums = rows.groupBy("d").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n")).select(F.array().cast("array<int>").alias("p"), "d", "b", "n")
        counted: dict[tuple[int, ...], dict[int, int]] = {}
        single: set[tuple[int, ...]] = set()  # intervals of one row, which can't be split
        for r in sums.collect():  # at most (shards - 1) * 2 ** bits rows
            counted.setdefault(tuple(r["p"]), {})[r["d"]] = r["b"]
            if r["n"] == 1:
                single.add((*r["p"], r["d"]))
        if not level:
            total = sum(counted.get((), {}).values())
            open_at = {(): (0.0, [(i, total * i / shards) for i in range(1, shards)])}
        most = tolerance * total / shards
        further: dict[tuple[int, ...], tuple[float, list[tuple[int, float]]]] = {}
        for prefix, (below, targets) in open_at.items():
            edges, at = [(below, 0)], below
            for d in range(2**bits):
                at += counted.get(prefix, {}).get(d, 0)
                edges.append((at, d + 1))
            for i, target in targets:
                bytes_below, edge = min(edges, key=lambda e: (abs(e[0] - target), e[1]))
                d = next((d for d in range(2**bits) if edges[d + 1][0] > target), 2**bits - 1)
                if abs(bytes_below - target) <= most or level == levels - 1 or (*prefix, d) in single:
                    splitters.append((*prefix, edge))
                    continue
                further.setdefault((*prefix, d), (edges[d][0], []))[1].append((i, target))
        open_at = further
        if not open_at:
            return sorted(splitters), level + 1
    return sorted(splitters), levels


def _not_below(splitter: tuple[int, ...], bits: int) -> Column:
    """Whether a row's digits aren't below the splitter's. The splitter's last digit may be 2 ** bits, above all digits."""
    found = _digit(len(splitter) - 1, bits) >= F.lit(splitter[-1])
    for level in range(len(splitter) - 2, -1, -1):
        d = _digit(level, bits)
        found = (d > F.lit(splitter[level])) | ((d == F.lit(splitter[level])) & found)
    return found


def shard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, tolerance: float = TOLERANCE, bits: int = BITS, buckets: int = BUCKETS) -> DataFrame:
    """Per row: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(8), F.col(id_col)).alias("k2"),
    )
    keyed = stored(keyed, "keys")
    splitters, _ = find_splitters(keyed, shards, tolerance, bits)
    at = F.lit(0)
    for s in splitters:
        at = at + _not_below(s, bits).cast("int")
    rows = keyed.withColumn("shard", at.cast("int")).withColumn("bucket", F.pmod(F.col("k2"), F.lit(buckets)).cast("int"))
    counts = rows.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))  # at most shards * buckets rows
    before = (F.sum("n").over(W.partitionBy("shard").orderBy("bucket")) - F.col("n")).alias("before")
    rows = rows.join(F.broadcast(counts.select("shard", "bucket", before)), ["shard", "bucket"])
    place = F.row_number().over(W.partitionBy("shard", "bucket").orderBy("k2", "k1", "doc_id"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + place - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
