"""Tables that cut lineage, kept in the checkpoint folder that the session names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``. Local runs without one get a folder of their own."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder:
        return folder
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    folder = tempfile.mkdtemp(prefix="cohortspark-")
    context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def shuffled(df: DataFrame) -> DataFrame:
    """The same rows, as the side of a join that has about one row per key, to be joined by shuffle or by layout.

    Spark broadcasts by the size of files or of shuffled bytes, and many times as much passes through the driver. Tables that
    grow with the persons or events are not sent at any size; each task builds a hash table of its share of the keys.
    """
    return df.hint("shuffle_hash")


class Scratch:
    """Written intermediate tables of one run: they outlive lost executors and shorten later plans."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_folder(spark).rstrip('/')}/cohortspark-{uuid.uuid4().hex}"
        self._tables = 0
        self._kept: set[str] = set()
        self._laid_out: list[str] = []

    def write(self, df: DataFrame, label: str, *folders: str) -> str:
        """Write the rows as a new table, with a folder for each value of the given columns, and return its path."""
        self._tables += 1
        path = f"{self.root}/{self._tables:04d}-{label}"
        df.write.partitionBy(*folders).parquet(path)
        self._kept.add(path)
        return path

    def read(self, path: str | list[str], schema: StructType) -> DataFrame:
        """A written table, or several of one schema as one scan."""
        return self.spark.read.schema(schema).parquet(*([path] if isinstance(path, str) else path))

    def cut(self, df: DataFrame, label: str, *folders: str) -> DataFrame:
        """The same rows, read back from a written table."""
        return self.read(self.write(df, label, *folders), df.schema)

    def cut_by(self, df: DataFrame, label: str, *keys: str) -> DataFrame:
        """The same rows, read back from a table laid out by keys: bucketed and sorted, in as many buckets as the session
        shuffles to. Joins and aggregations on these keys need no exchange of it."""
        self._tables += 1
        path = f"{self.root}/{self._tables:04d}-{label}"
        table = f"{self.root.rsplit('/', 1)[1].replace('-', '_')}_{self._tables:04d}"
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        (df.repartition(buckets, *keys).write.bucketBy(buckets, *keys).sortBy(*keys).format("parquet").option("path", path)
         .saveAsTable(table))
        self._kept.add(path)
        self._laid_out.append(table)
        return self.spark.table(table)

    def _files(self, path: str):
        jvm_path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return jvm_path, jvm_path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def intact(self) -> bool:
        """Whether every table that was written and not discarded is still there."""
        for path in self._kept:
            jvm_path, files = self._files(path)
            if not files.exists(jvm_path):
                return False
        return True

    def discard(self, path: str) -> None:
        """Delete a table that nothing reads any more."""
        jvm_path, files = self._files(path)
        files.delete(jvm_path, True)
        self._kept.discard(path)

    def close(self) -> None:
        """Delete all tables of the run."""
        for table in self._laid_out:
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        self._laid_out.clear()
        self.discard(self.root)
        self._kept.clear()
