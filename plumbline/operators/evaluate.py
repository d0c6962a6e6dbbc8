"""Quality of search results: recall, reciprocal rank, percentiles, result tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.plans.cutting import cut

#: What hits are divided by: k; the least of k and the truth's size; the least of these and the result's size.
DENOMINATORS = ("k", "truth", "retrieved")


def recall_at_k(results: DataFrame, truth: DataFrame, k: int, denominator: str = "k") -> DataFrame:
    """(qid, hits, recall) of ranked results (qid, id, rank) against truth (qid, id, rank), both cut at k."""
    r, t = results.filter(F.col("rank") <= k), truth.filter(F.col("rank") <= k)
    hits = r.join(t.select("qid", "id"), ["qid", "id"], "left_semi").groupBy("qid").agg(F.count(F.lit(1)).alias("hits"))
    df = t.groupBy("qid").agg(F.count(F.lit(1)).alias("gt")).join(r.groupBy("qid").agg(F.count(F.lit(1)).alias("got")), "qid", "left").join(hits, "qid", "left")
    df = df.withColumn("hits", F.coalesce("hits", F.lit(0).cast("long")))
    by: Column = {"k": F.lit(k), "truth": F.least(F.lit(k), "gt"), "retrieved": F.least(F.lit(k), "gt", F.coalesce("got", F.lit(0)))}[denominator]
    return df.select("qid", "hits", F.when(by > 0, F.col("hits") / by).otherwise(F.lit(0.0)).alias("recall"))


def mrr_at_k(results: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """(qid, mrr): 1 by the rank of the first result that is in the truth; 0 without one among k."""
    first = results.filter(F.col("rank") <= k).join(truth.select("qid", "id"), ["qid", "id"], "left_semi").groupBy("qid").agg(F.min("rank").alias("first"))
    return truth.select("qid").distinct().join(first, "qid", "left").select("qid", F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr"))


def percentile(df: DataFrame, value: str, percents: list[int]) -> DataFrame:
    """(percent, value): the value at place n * percent / 100, rounded down, of the sorted values. Values are sorted in parts by ranges; only the parts' counts
    meet, and no values are gathered."""
    parts = cut(df.groupBy(F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("c")).repartitionByRange("value").withColumn("_part", F.spark_partition_id()))
    sums = parts.groupBy("_part").agg(F.sum("c").alias("s"))
    before = sums.select("_part", (F.sum("s").over(W.orderBy("_part")) - F.col("s")).alias("before"), F.sum("s").over(W.partitionBy()).alias("n"))  # a row per part
    placed = parts.join(F.broadcast(before), "_part").withColumn("upto", F.col("before") + F.sum("c").over(W.partitionBy("_part").orderBy("value")))
    want = F.explode(F.array(*map(F.lit, percents))).alias("percent")
    at = F.least(F.floor(F.col("n") * F.col("percent") / 100), F.col("n") - 1)
    return placed.select("value", "upto", "c", "n", want).filter((F.col("upto") > at) & (F.col("upto") - F.col("c") <= at)).select(F.col("percent").cast("long").alias("percent"), "value")


def results_table(rows: list[dict[str, object]]) -> str:
    """Benchmark results as a Markdown table."""
    if not rows:
        return ""
    names = list(rows[0])
    show = lambda x: f"{x:.3f}" if isinstance(x, float) else str(x)
    return "\n".join(["| " + " | ".join(names) + " |", "|" + "---|" * len(names), *("| " + " | ".join(show(r[n]) for n in names) + " |" for r in rows)])


def recall_sweep(searches: dict[str, DataFrame], truth: DataFrame, k: int) -> DataFrame:
    """(setting, queries, recall): the mean recall at k of several searches (qid, id, rank) against one truth, such as those of growing beams."""
    out = None
    for name, found in searches.items():
        row = recall_at_k(found, truth, k).agg(F.count(F.lit(1)).alias("queries"), F.avg("recall").alias("recall")).select(F.lit(name).alias("setting"), "queries", "recall")
        out = row if out is None else out.unionByName(row)
    return out
