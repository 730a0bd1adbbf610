"""An archive table in key buckets: upserts write deltas of the buckets they touch, reads merge only those.

A version is a folder of Parquet files, partitioned by bucket. The manifest of the newest version names, for each
bucket, the versions that hold its rows; it is written last, so a version without one does not count. One writer at a time.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.sources.archive import latest


class BucketedTable:
    """Rows by key, the newest of each counts (by the column `at`, then as latest() decides)."""

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], at: str, buckets: int = 64):
        self.spark, self.path, self.keys, self.at, self.buckets = spark, path.rstrip("/"), list(keys), at, buckets

    def _exists(self, path: str) -> bool:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where)

    def manifest(self) -> dict:
        """version, and files: the versions of each bucket, oldest first."""
        if not self._exists(f"{self.path}/manifest"):
            return {"version": 0, "files": {}}
        found = self.spark.read.text(f"{self.path}/manifest/*/*.txt").collect()
        return max((json.loads(r.value) for r in found), key=lambda m: m["version"], default={"version": 0, "files": {}})

    def _commit(self, version: int, files: dict[str, list[int]]) -> None:
        text = json.dumps({"version": version, "files": files})
        self.spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{self.path}/manifest/{version}")

    def _bucket(self):
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _written(self, rows: DataFrame, version: int) -> list[str]:
        """Writes a version; the buckets that it has."""
        rows.withColumn("_bucket", self._bucket()).repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/data/{version}")
        if not self._exists(f"{self.path}/data/{version}/_SUCCESS"):
            raise OSError(f"version {version} was not written")
        data = self.spark.read.parquet(f"{self.path}/data/{version}")
        return [str(r._bucket) for r in data.select("_bucket").distinct().collect()] if "_bucket" in data.columns else []

    def upsert(self, changes: DataFrame) -> list[str]:
        """Inserts or replaces by key; the buckets that were touched."""
        known = self.manifest()
        version = known["version"] + 1
        if changes.isEmpty():
            return []
        touched = self._written(changes, version)
        self._commit(version, known["files"] | {b: [*known["files"].get(b, []), version] for b in touched})
        return touched

    def _read(self, version: int, buckets: Sequence[str]) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/data/{version}").where(F.col("_bucket").isin([int(b) for b in buckets]))

    def _merged(self, files: dict[str, list[int]]) -> DataFrame:
        """The newest row of each key in buckets of several versions."""
        versions = sorted({v for of in files.values() for v in of})
        parts = [self._read(v, [b for b, of in files.items() if v in of]) for v in versions]
        return latest(reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts), self.keys, self.at)

    def read(self) -> DataFrame:
        """The table: buckets of one compacted version are read as they are, the others merged."""
        files = self.manifest()["files"]
        if not files:
            raise ValueError(f"{self.path} holds no version")
        # a first version may hold a key twice, so only what compact() or a merge has written is plain
        plain = {b: of for b, of in files.items() if len(of) == 1 and of[0] < 0}
        rest = {b: of for b, of in files.items() if b not in plain}
        parts = [self._read(v, [b for b, of in plain.items() if of[0] == v]) for v in sorted({of[0] for of in plain.values()})]
        if rest:
            parts.append(self._merged(rest))
        return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts).drop("_bucket")

    def compact(self, most: int = 0) -> list[str]:
        """Rewrites the buckets of more than `most` deltas as one version each; the buckets that were."""
        known = self.manifest()
        many = {b: of for b, of in known["files"].items() if sum(v > 0 for v in of) > most}
        if not many:
            return []
        version = known["version"] + 1
        self._written(self._merged(many).drop("_bucket"), -version)
        self._commit(version, known["files"] | {b: [-version] for b in many})
        return list(many)
