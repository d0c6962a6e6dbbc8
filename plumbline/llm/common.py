"""Helpers shared by the text operators."""

from __future__ import annotations

import ctypes
import re
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than space and U+0009 to U+000D.
WORD = re.compile("[^ \t-\r]+")
WORD_SQL = r"[^\x20\x09-\x0D]+"
#: str.split() also splits at these, which are no white space for us.
_ODD = ("\x1c", "\x1d", "\x1e", "\x1f")
#: Bytes of a row group of stored tables, so that open writers hold little.
ROW_GROUP = 16_000_000
#: ASCII capitals to lower case, nothing else.
ASCII_LOWER = {c: c + 32 for c in range(65, 91)}
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: str) -> list[str]:
    """The words of a text. ASCII text without separators U+001C to U+001F takes the faster str.split()."""
    if text.isascii() and not any(c in text for c in _ODD):
        return text.split()
    return WORD.findall(text)


def tokens_of(text: str) -> list[str]:
    """The text cut at white space of any kind; U+001C to U+001F are no white space here."""
    return WORD.findall(text) if any(c in text for c in _ODD) else text.split()


def slices(batches: Iterable[pa.RecordBatch], rows: int = 1024, most_bytes: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """Batches of few rows, and of one row or few bytes, so that few texts are Python strings at once."""
    for whole in batches:
        step = rows
        if whole.nbytes > most_bytes:
            step = max(1, min(rows, whole.num_rows * most_bytes // whole.nbytes))
        for lo in range(0, whole.num_rows, step):
            part = whole.slice(lo, step)
            if part.num_rows > 1 and part.nbytes > 2 * most_bytes:  # a few long texts among short ones
                yield from (part.slice(i, 1) for i in range(part.num_rows))
            else:
                yield part


def freeing(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, a task's function over batches; when it has ended, what it has freed goes back to the system, as the worker process lives on."""

    def task(batches: Iterator) -> Iterator:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if sys.platform == "linux":
            ctypes.CDLL(None).malloc_trim(0)

    return task


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir of the session. Where it is unset, a master on this machine alone gets a
    folder of our own, and any other is refused, as its executors wouldn't see one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="plumbline-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def stored_at(df: DataFrame, name: str = "t") -> tuple[DataFrame, str]:
    """The frame written to a Parquet table in the shared folder and read again: columnar, compressed, cut from its lineage; and its path."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/plumbline-{name}-{uuid.uuid4().hex}"
    df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def stored(df: DataFrame, name: str = "t") -> DataFrame:
    return stored_at(df, name)[0]


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a stored table that no frame in use reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def docs_repeat(docs: DataFrame, id_col: str) -> bool:
    """Whether an id stands in more than one row."""
    return bool(docs.groupBy(id_col).count().filter("count > 1").limit(1).count())


def numbered(docs: DataFrame) -> DataFrame:
    """Whole rows as _all and a number of each as _row, stored, for rows that their ids don't tell apart."""
    return stored(docs.select(F.struct(*docs.columns).alias("_all"), F.monotonically_increasing_id().alias("_row")), "rows")


def ascii_lower(col):
    """Lower-cases A-Z only."""
    return F.translate(col, UPPER, LOWER)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")
