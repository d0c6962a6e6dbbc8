"""Versioned tables of Parquet files in a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


class Versions:
    """Numbered folders v1, v2, ..., each with some named tables. A version counts once its mark is there, which is written last, so that a job that dies leaves none
    behind that is half written. A table that a version lacks is as in the version before it."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        self._fs = self._path.getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._at(name))

    def delete(self, name: str) -> None:
        self._fs.delete(self._at(name), True)

    def names(self) -> list[str]:
        return [s.getPath().getName() for s in self._fs.listStatus(self._path)] if self._fs.exists(self._path) else []

    def known(self) -> list[int]:
        """Finished versions in order."""
        return sorted(int(n[1:]) for n in self.names() if n.startswith("v") and n[1:].isdigit() and self.exists(f"{n}/_DONE"))

    def read(self, table: str, schema: str) -> DataFrame:
        """A table of the latest version; an empty one where there is none."""
        found = next((v for v in reversed(self.known()) if self.exists(f"v{v}/{table}")), None)
        if found is None:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.folder}/v{found}/{table}")

    def write(self, tables: dict[str, DataFrame]) -> int:
        """Writes the tables of a new version, those that aren't the same as before. Gives its number."""
        version = (self.known() or [0])[-1] + 1
        self.delete(f"v{version}")  # what a job that died has left
        for name, df in tables.items():
            df.write.parquet(f"{self.folder}/v{version}/{name}")
        self.mark(f"v{version}")
        return version

    def touch(self, name: str) -> None:
        """Writes an empty file."""
        self._fs.create(self._at(name)).close()

    def mark(self, name: str) -> None:
        """Makes a folder count as finished."""
        self.touch(f"{name}/_DONE")
