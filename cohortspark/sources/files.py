"""Result files, and sets of them that are published as a whole."""

from __future__ import annotations

import re
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_MANIFEST = "version long, name string, path string, rows long, schema string, digest string"


def write_csv(df: DataFrame, path: str) -> None:
    """A folder of CSV files with a header, missing values as NA and no row numbers."""
    df.write.mode("overwrite").csv(path, header=True, nullValue="NA")


def read_csv(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """What ``write_csv`` wrote."""
    return spark.read.schema(schema).csv(path, header=True, nullValue="NA")


def write_table(df: DataFrame, path: str) -> None:
    """The typed form of a result."""
    df.write.mode("overwrite").parquet(path)


def digest(df: DataFrame) -> tuple[int, str]:
    """Number of rows and a digest of them that does not depend on their order; repeated rows count."""
    row = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"})
    halves = [F.conv(F.substring(F.sha2(row, 256), start, 15), 16, 10).cast("decimal(38,0)") for start in (1, 16)]
    counted = df.agg(F.count(F.lit(1)).alias("n"), *[F.sum(h).alias(f"h{i}") for i, h in enumerate(halves)]).first()
    return counted["n"], "-".join(str(counted[f"h{i}"] or 0) for i in range(2))


class ResultSet:
    """Results of one site in a folder, published together or not at all.

    A new set is written to a folder of its own and read back for its manifest: names, paths, number of rows, schemas and
    digests. The manifest is the last table to be written, under the next version number, and counts only once Spark has marked
    it as complete. So a run that dies before leaves the set before it as it was, and readers never see a mixture.
    """

    def __init__(self, spark: SparkSession, folder: str, site: str):
        if not re.fullmatch(r"[A-Za-z0-9_.-]+", site):
            raise ValueError(f"{site!r} is no plain name")
        self.spark, self.folder, self.site = spark, folder.rstrip("/"), site

    def _manifest(self, version: int) -> str:
        return f"{self.folder}/{self.site}-manifest-{version:06d}"

    def _exists(self, path: str) -> bool:
        jvm_path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return jvm_path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).exists(jvm_path)

    def version(self) -> int:
        """The newest published version, 0 if there is none."""
        version = 0
        while self._exists(f"{self._manifest(version + 1)}/_SUCCESS"):
            version += 1
        return version

    def publish(self, results: Mapping[str, DataFrame]) -> dict[str, str]:
        """Write all results as CSV and publish them as the next version; returns their paths."""
        version = self.version() + 1
        place = f"{self.folder}/{self.site}-set-{uuid.uuid4().hex}"
        paths, entries = {}, []
        for name, df in results.items():
            paths[name] = f"{place}/{self.site}-{name}.csv"
            write_csv(df, paths[name])
            schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
            rows, made = digest(read_csv(self.spark, paths[name], schema))
            entries.append((version, name, paths[name], rows, schema, made))
        # A manifest that an earlier run left unfinished is replaced.
        self.spark.createDataFrame(entries, _MANIFEST).coalesce(1).write.mode("overwrite").json(self._manifest(version))
        return paths

    def manifest(self, version: int | None = None) -> DataFrame:
        """The manifest of a version, by default the newest."""
        version = version or self.version()
        if not version:
            raise FileNotFoundError(f"no published results of {self.site} in {self.folder}")
        return self.spark.read.schema(_MANIFEST).json(self._manifest(version))

    def read(self, name: str, version: int | None = None, check: bool = True) -> DataFrame:
        """A result as its manifest describes it; files that were changed since raise an error."""
        entry = self.manifest(version).filter(F.col("name") == name).first()
        if entry is None:
            raise KeyError(name)
        df = read_csv(self.spark, entry["path"], StructType.fromDDL(entry["schema"]))
        if check and digest(df) != (entry["rows"], entry["digest"]):
            raise ValueError(f"{entry['path']} is not what was published")
        return df
