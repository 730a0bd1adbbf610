"""Tables in the folder that driver and executors share: lineage is cut there, and lost executors cost no recomputation."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset and all runs on one machine, a new folder, which is then set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _files(spark: SparkSession, path: str) -> tuple:
    """A path, and the file system that it is in, as Hadoop knows them."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back; the table is deleted when the session's JVM ends, if nothing does so before."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    at, files = _files(df.sparkSession, path)
    files.deleteOnExit(at)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def dropped(*tables: DataFrame | None) -> None:
    """Deletes tables that stored() made and nothing reads any more."""
    for path, spark in [(getattr(t, "_stored_at", None), t.sparkSession) for t in tables if t is not None]:
        if path:
            at, files = _files(spark, path)
            files.delete(at, True)
            files.cancelDeleteOnExit(at)


class Tables:
    """The tables that a computation stores, so that all but those its result reads can be deleted at its end."""

    def __init__(self) -> None:
        self.made: list[DataFrame] = []

    def stored(self, df: DataFrame, name: str) -> DataFrame:
        self.made.append(stored(df, name))
        return self.made[-1]

    def drop(self, keep: Iterable[DataFrame] = ()) -> None:
        kept = {id(t) for t in keep}
        dropped(*[t for t in self.made if id(t) not in kept])
        self.made = [t for t in self.made if id(t) in kept]
