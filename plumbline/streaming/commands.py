"""A command stream over a store: ingest, vacuum and search in their order, as Structured Streaming micro-batches."""

from __future__ import annotations

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from plumbline.operators.store import VectorStore
from plumbline.plans.cutting import cut
from plumbline.plans.tables import Versions
from plumbline.schema import METADATA, EngineError, SearchConfig

SCHEMA = f"seq long, op string, node_id long, embedding array<float>, metadata {METADATA}, cfg struct<limit: int, rerank_k: int, enable_reranking: boolean>"
class Shutdown(EngineError):
    """Ends a stream of commands."""


OPS = ("ingest", "vacuum", "search", "stats", "shutdown")


def apply_batch(store: VectorStore, commands: DataFrame, replies: str, batch: int | None = None) -> bool:
    """Applies a batch in order of seq and appends replies (seq, op, node_id, rank, score, error) to a folder. Neighbouring commands of one kind are applied together,
    which changes nothing they can see; the driver holds one row per such run. Gives whether a shutdown came; commands behind it are not applied.

    With a batch's number, each run's step is noted beside the replies when it is done, together with the store's version before it: a batch that is replayed after a
    failure goes on where it stopped, and a step that died halfway is undone first, so nothing is stored or answered twice."""
    steps = Versions(store.spark, f"{replies.rstrip('/')}/_steps")
    parts = cut(commands.repartitionByRange("seq").withColumn("_part", F.spark_partition_id()))
    before = F.lag("op").over(W.partitionBy("_part").orderBy("seq"))
    ends = parts.groupBy("_part").agg(F.max_by("op", "seq").alias("last"))
    ends = ends.select("_part", F.lag("last").over(W.orderBy("_part")).alias("_before"))  # a row per part
    marked = parts.join(F.broadcast(ends), "_part").withColumn("_new", (F.coalesce(before, F.col("_before"), F.lit("")) != F.col("op")).cast("long"))
    counts = marked.groupBy("_part").agg(F.sum("_new").alias("_n"))
    counts = counts.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_upto"))
    runs = cut(marked.join(F.broadcast(counts), "_part").withColumn("run", F.col("_upto") + F.sum("_new").over(W.partitionBy("_part").orderBy("seq"))).drop("_part", "_before", "_new", "_upto"))
    for row in runs.groupBy("run", "op").count().orderBy("run").collect():
        name = f"b{batch}r{row['run']}"
        if row["op"] == "shutdown":
            served = batch is not None and steps.exists(f"{name}/done")  # by a try before; the stream goes on behind this batch
            if batch is not None:
                steps.touch(f"{name}/done")
            return not served
        if batch is not None:
            if steps.exists(f"{name}/done"):
                continue
            _undo(store, steps, name)
        _apply(store, row["op"], runs.filter(F.col("run") == row["run"])).write.mode("overwrite" if batch is not None else "append").parquet(f"{replies.rstrip('/')}/{name}" if batch is not None else replies)
        if batch is not None:
            steps.touch(f"{name}/done")
    return False


def _undo(store: VectorStore, steps: Versions, name: str) -> None:
    """Deletes versions that an earlier try of a step has written; the first try notes which one was the last before it."""
    last = (store.versions() or [0])[-1]
    noted = [n for n in steps.names() if n.startswith(f"{name}-from-")]
    if not noted:
        steps.touch(f"{name}-from-{last}")
        return
    for version in range(int(noted[0].rsplit("-", 1)[1]) + 1, last + 1):
        store.kept.delete(f"v{version}")


def read_replies(spark: SparkSession, replies: str) -> DataFrame:
    """All replies to a stream's commands."""
    return spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").parquet(replies)


def _apply(store: VectorStore, op: str, part: DataFrame) -> DataFrame:
    reply = lambda df, **cols: df.select("seq", F.lit(op).alias("op"), *(cols.get(n, F.lit(None)).cast(t).alias(n) for n, t in (("node_id", "long"), ("rank", "long"), ("score", "double"), ("error", "string"))))
    if op == "ingest":
        return reply(store.ingest(part.select("seq", "embedding", "metadata")), node_id=F.col("node_id"), error=F.col("error"))
    if op == "vacuum":
        had = store.snapshot().select("node_id").join(part.select("node_id").distinct(), "node_id", "left_semi").withColumn("had", F.lit(True))
        known = part.select("seq", "node_id").join(had, "node_id", "left")
        known = cut(known)
        store.vacuum(part.select("node_id"))
        return reply(known, node_id=F.col("node_id"), error=F.when(F.col("had").isNull(), F.lit("no such node")))
    if op == "search":
        bad = F.coalesce(F.size("embedding"), F.lit(0)) != store.dimensions
        out = reply(part.filter(bad), error=F.lit(f"expected {store.dimensions} dimensions"))
        kinds = part.filter(~bad).select(F.coalesce("cfg.limit", F.lit(10)).alias("limit"), "cfg.rerank_k", F.coalesce("cfg.enable_reranking", F.lit(False)).alias("rerank"))
        for c in kinds.distinct().collect():  # one search per different configuration
            mine = part.filter(~bad).filter((F.coalesce("cfg.limit", F.lit(10)) == c["limit"]) & F.col("cfg.rerank_k").eqNullSafe(F.lit(c["rerank_k"]).cast("int")) & (F.coalesce("cfg.enable_reranking", F.lit(False)) == c["rerank"]))
            found = store.search(mine.select((-F.col("seq") - 1).alias("qid"), F.col("embedding").alias("q")), SearchConfig(limit=c["limit"], rerank_k=c["rerank_k"], enable_reranking=c["rerank"]))
            out = out.unionByName(reply(found.withColumn("seq", -F.col("qid") - 1), node_id=F.col("id"), rank=F.col("rank"), score=F.col("score")))
        return out
    if op == "stats":
        return reply(part.crossJoin(F.broadcast(store.stats().select("total_nodes"))), node_id=F.col("total_nodes"))
    return reply(part, error=F.lit("unknown command"))


def start(spark: SparkSession, commands: str, store: VectorStore, replies: str, checkpoint: str, files_per_batch: int = 16, once: bool = True, interval: str | None = None) -> StreamingQuery:
    """Reads command files (JSON) as they come, ``files_per_batch`` at a time; with ``once`` until those there now are done, else at once or by an interval such as
    "10 seconds", at the end of which what a batch has stored can be seen. A shutdown ends the query once its batch's replies are written; later files wait."""
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_batch).json(commands)
    steps = Versions(spark, f"{replies.rstrip('/')}/_steps")

    def apply(df: DataFrame, batch: int) -> None:
        if steps.exists("shutdown"):
            raise Shutdown(f"shut down before batch {batch}")
        if apply_batch(store, df, replies, batch):
            steps.touch("shutdown")
            raise Shutdown(f"shut down in batch {batch}")

    writer = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    if once:
        writer = writer.trigger(availableNow=True)
    elif interval:
        writer = writer.trigger(processingTime=interval)
    return writer.start()


def finish(query: StreamingQuery) -> bool:
    """Waits for the query's end. Gives whether a shutdown ended it; other failures are raised."""
    try:
        query.awaitTermination()
    except StreamingQueryException as failed:
        if Shutdown.__name__ not in str(failed):
            raise
        return True
    return False


def restart(spark: SparkSession, replies: str) -> None:
    """Lets a stream that was shut down go on, behind the shutdown's batch."""
    Versions(spark, f"{replies.rstrip('/')}/_steps").delete("shutdown")
