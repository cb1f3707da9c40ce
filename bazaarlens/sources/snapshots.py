"""Snapshots in versions, each a table bucketed by key, so that a merge shuffles what comes in and not what is stored."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Snapshot:
    """Versions ``v00000000``, ``v00000001`` ... in one folder; a version counts once its job has committed (``_SUCCESS``).

    All have the same number of buckets by the same key, so a join on that key reads each bucket where it lies. Writing
    a version that is there already changes nothing; one that was left half-written is written anew. Tables are known to
    a session by name; a session that does not know a version yet learns it from its files.
    """

    spark: SparkSession
    path: str
    name: str
    key: tuple[str, ...] = ("source", "source_id")
    buckets: int = 16

    def at(self, number: int) -> str:
        return f"{self.path}/v{number:08d}"

    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def versions(self) -> list[int]:
        """Numbers of the committed versions, ascending."""
        fs, at = self._fs(f"{self.path}/v*/_SUCCESS")
        return sorted(int(f.getPath().getParent().getName()[1:]) for f in fs.globStatus(at) or ())

    def newest(self, before: int | None = None) -> int | None:
        return max((v for v in self.versions() if before is None or v < before), default=None)

    def read(self, number: int | None = None) -> DataFrame:
        """A version, by default the newest."""
        number = self.newest() if number is None else number
        if number is None:
            raise FileNotFoundError(f"no version in {self.path}")
        table = f"{self.name}_v{number:08d}"
        if not self.spark.catalog.tableExists(table):
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.spark.read.parquet(self.at(number)).schema)
            keys = ", ".join(f"`{k}`" for k in self.key)
            self.spark.sql(f"create table {table} ({columns}) using parquet clustered by ({keys}) sorted by ({keys}) into {self.buckets} buckets location '{self.at(number)}'")
        return self.spark.table(table)

    def write(self, df: DataFrame, number: int) -> None:
        """``df`` as that version; without effect if it is there."""
        if number in self.versions():
            return
        table = f"{self.name}_v{number:08d}"
        self.spark.sql(f"drop table if exists {table}")
        fs, at = self._fs(self.at(number))
        fs.delete(at, True)  # left by a job that did not commit
        df.write.bucketBy(self.buckets, *self.key).sortBy(*self.key).option("path", self.at(number)).format("parquet").saveAsTable(table)

    def vacuum(self, keep: int = 2) -> None:
        """Removes all but the newest versions."""
        for v in self.versions()[:-keep]:
            self.spark.sql(f"drop table if exists {self.name}_v{v:08d}")
            fs, at = self._fs(self.at(v))
            fs.delete(at, True)
