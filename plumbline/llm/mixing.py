"""Operator 2: mixing sources to target weights by subset-sum budget fitting.

Each source gets a target: its weight's share of a total, capped at a multiple of
its own size, the excess dealt again by weight. Documents are counted by exact
length. Every document of a source is taken once if the target allows it; the
rest of the target is a budget. A share of every length's documents is taken in
proportion, and what then remains of the budget is met by a bounded-knapsack
dynamic program over the remaining documents' lengths. How many documents of a
length are taken is thereby fixed; which ones is decided by a seeded hash.

Only (source, length) counts meet in one task per source, as many rows as a
source has distinct lengths. Which documents of a length are taken is decided in
hashed buckets of about a thousand rows, so neither a hot source nor a hot length
meets in one task.

Defined results: a null text has size 0, and null is a source of its own, the
last. Documents of size 0 are never taken beyond the whole copies that all of
their source's documents get. Repeated rows count each; which of several equal
rows is taken is open. An empty table gives an empty table. Other columns are
ignored by ``mix`` and kept by ``mixed_rows``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD_SQL, docs_repeat, numbered, stored

WEIGHTS = (5, 2, 1)
SHARE = 1.5
REPEATS = 2
SEED = 20
#: Budgets up to this are met by the dynamic program.
PROGRAM = 4096
#: About so many rows of one length are ranked together.
BUCKET = 1024
#: Lengths of a source that are looked up in a broadcast table, at most.
HOT_LENGTHS = 100_000


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeats: float = REPEATS) -> DataFrame:
    """Per source: source_size and target. A target is the least of repeats * source_size and weight * level; the level, the same for
    all, spends the total. Sources sorted by repeats * source_size / weight meet their caps in this order, so prefix sums give it."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = W.orderBy(F.col("source").asc_nulls_last())  # one row per source
    k = (F.row_number().over(place) - 1) % len(weights)
    df = totals.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), k + 1).cast("double")).withColumn("cap", F.lit(float(repeats)) * F.col("source_size"))
    order = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    upto, after = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(W.currentRow, W.unboundedFollowing)
    everything = W.partitionBy()
    df = df.withColumn("total", F.lit(float(share)) * F.sum("source_size").over(everything))
    df = df.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(upto), F.lit(0.0))) / F.sum("weight").over(after))
    # the level holds at the first source whose cap it doesn't reach; where it reaches all, every source is at its cap
    df = df.withColumn("level", F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), F.col("level")))).over(everything)["level"])
    return df.select("source", "source_size", F.coalesce(F.least(F.col("cap"), F.col("weight") * F.col("level")), F.col("cap")).alias("target"))


def nearest_sum(lengths: list[int], counts: list[int], budget: int) -> dict[int, int]:
    """How many of each length to take so that their sum is as near the budget as can be, the smaller of two as near."""
    if budget <= 0 or not lengths:
        return {}
    limit = 2 * budget  # a sum above it is farther than none at all
    mask = (1 << limit + 1) - 1
    items: list[tuple[int, int, int]] = []
    first = np.full(limit + 1, -1, np.int32)  # the item with which a sum first came up
    reach = 1
    for length, count in zip(lengths, counts, strict=True):
        most, part = min(count, limit // length), 1
        while most > 0 and not reach >> budget & 1:
            part = min(part, most)
            new = (reach << length * part) & mask & ~reach
            if new:
                bits = np.unpackbits(np.frombuffer(new.to_bytes(limit // 8 + 1, "little"), np.uint8), bitorder="little")
                first[np.flatnonzero(bits[: limit + 1])] = len(items)
                reach |= new
            items.append((length, part, length * part))
            most -= part
            part *= 2
    best = min(np.flatnonzero(np.concatenate(([True], first[1:] >= 0))).tolist(), key=lambda s: (abs(s - budget), s))
    taken: dict[int, int] = {}
    while best:
        length, part, total = items[first[best]]
        taken[length] = taken.get(length, 0) + part
        best -= total
    return taken


def fit_budget(lengths: list[int], counts: list[int], budget: int, seed: int = SEED, program: int = PROGRAM) -> list[int]:
    """How many of each length to take, at most its count, so that their sum comes near the budget."""
    whole = sum(n * c for n, c in zip(lengths, counts, strict=True))
    if budget >= whole:
        return list(counts)
    share = budget / whole if whole else 0.0
    taken = [min(c, int(share * c)) if n else 0 for n, c in zip(lengths, counts, strict=True)]
    left = budget - sum(n * t for n, t in zip(lengths, taken, strict=True))
    order = np.random.default_rng(seed).permutation(len(lengths)).tolist()
    moved = True
    while left > program and moved:
        moved = False
        for i in order:
            if left <= program:
                break
            if 0 < lengths[i] <= left and taken[i] < counts[i]:
                taken[i] += 1
                left -= lengths[i]
                moved = True
    at = {lengths[i]: i for i in order if lengths[i] > 0 and taken[i] < counts[i]}
    for length, n in nearest_sum(list(at), [counts[i] - taken[i] for i in at.values()], left).items():
        taken[at[length]] += n
    return taken


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS, seed: int = SEED) -> DataFrame:
    """Per row: doc_id, source, size, source_size, target, copies, taken (copies * size)."""
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD_SQL)), F.lit(0)).cast("long")
    sizes = stored(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), size.alias("size")), "sizes")
    targets = source_targets(sizes, weights, share, repeats)
    counts = sizes.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
    same = lambda a, b: a["source"].eqNullSafe(b["source"])

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("size", ascending=False)
        target, whole = float(pdf["target"].iat[0]), int(pdf["source_size"].iat[0])
        base = int(target // whole) if whole else 0
        if base >= repeats:
            more = [0] * len(pdf)
        else:
            more = fit_budget(pdf["size"].tolist(), pdf["n"].tolist(), int(target - base * whole + 0.5), seed)
        return pdf.assign(base=base, more=more)

    named = targets.select(F.col("source").alias("s"), "source_size", "target")
    plan = counts.join(named, counts["source"].eqNullSafe(named["s"])).drop("s")
    plan = plan.groupBy("source").applyInPandas(fit, "source string, size long, n long, source_size long, target double, base int, more long")
    plan = stored(plan, "plan")

    p = plan.select(F.col("source").alias("s"), F.col("size").alias("z"), "n", "source_size", "target", "base", "more")
    h = F.xxhash64(F.lit(seed), F.col("doc_id"))
    # lengths that many rows of a source share are looked up in a broadcast table of at most HOT_LENGTHS rows, so that no task gets all rows of one
    hot = p.filter(F.col("n") > F.lit(max(BUCKET, sizes.count() // HOT_LENGTHS)))
    fits = lambda t: sizes["source"].eqNullSafe(t["s"]) & (sizes["size"] == t["z"])
    rest = p.join(hot.select(F.col("s").alias("hs"), F.col("z").alias("hz")), F.col("s").eqNullSafe(F.col("hs")) & (F.col("z") == F.col("hz")), "left_anti")
    few = F.broadcast(hot)
    rows = sizes.join(few, fits(few)).unionByName(sizes.join(few, fits(few), "left_anti").join(rest, fits(rest))).drop("s", "z").withColumn("h", h)
    # the upper 32 bits of the hash, as a share of the length's buckets
    rows = rows.withColumn("bucket", F.floor(F.shiftrightunsigned("h", 32) / F.lit(2.0**32) * F.ceil(F.col("n") / F.lit(BUCKET))).cast("long"))
    part = (F.col("more") > 0) & (F.col("more") < F.col("n"))
    some = stored(rows.filter(part), "some")
    filled = some.groupBy("source", "size", "bucket").agg(F.count(F.lit(1)).alias("c"))
    filled = filled.withColumn("before", F.sum("c").over(W.partitionBy("source", "size").orderBy("bucket")) - F.col("c"))
    f = filled.select(F.col("source").alias("s"), F.col("size").alias("z"), F.col("bucket").alias("b"), "before")
    ranked = some.join(f, some["source"].eqNullSafe(f["s"]) & (some["size"] == f["z"]) & (some["bucket"] == f["b"])).drop("s", "z", "b")
    place = F.row_number().over(W.partitionBy("source", "size", "bucket").orderBy("h", "doc_id"))
    ranked = ranked.withColumn("extra", F.when(F.col("before") + place <= F.col("more"), 1).otherwise(0))
    whole = rows.filter(~part).withColumn("extra", F.when(F.col("more") > 0, 1).otherwise(0))
    columns = ["doc_id", "source", "size", "source_size", "target", (F.col("base") + F.col("extra")).cast("int").alias("copies")]
    out = whole.select(*columns).unionByName(ranked.select(*columns))
    return out.withColumn("taken", (F.col("copies") * F.col("size")).cast("long"))


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The rows of docs, each as often as the mix takes it. Where ids repeat, rows are told apart by their place in docs."""
    if docs_repeat(docs, id_col):
        rows = numbered(docs).withColumnRenamed("_row", "_doc")
        named = rows.select("_doc", F.col("_all").getField(text_col).alias("_text"), F.col("_all").getField(source_col).alias("_source"))
        copies = mix(named, "_doc", "_text", "_source", **options)
    else:
        rows = docs.select(F.struct(*docs.columns).alias("_all"), F.col(id_col).alias("_doc"))
        copies = mix(docs, id_col, text_col, source_col, **options)
    copies = copies.filter("copies > 0").select(F.col("doc_id").alias("_id"), "copies")
    rows = rows.join(copies, F.col("_doc").eqNullSafe(F.col("_id")))
    return rows.withColumn("_copy", F.explode(F.expr("sequence(1, copies)"))).select("_all.*")
