"""Stage tables: named Parquet tables under one base path, and scratch tables in the cluster's shared folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetrail.functions.columns import require_columns


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` where the cluster names one; else (local sessions only) a temporary folder."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="kinetrail-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def scratch(df: DataFrame, label: str, partition_by: list[str] | None = None) -> DataFrame:
    """``df`` written to the shared folder and read back: computed once, lineage cut, safe from lost executors."""
    path = f"{shared_dir(df.sparkSession)}/kinetrail/{label}-{uuid.uuid4().hex}"
    df.write.partitionBy(*(partition_by or [])).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class StageStore:
    """Reads and writes the pipeline's tables by name.

    Paths go through Spark only, so the base may be in any store that Spark reads.
    """

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def write(self, name: str, df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
        """Replace the table; with ``partition_by`` only the partitions that ``df`` holds, so a rerun of a job is idempotent."""
        writer = df.write.mode("overwrite")
        if partition_by:
            writer = writer.option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by)
        writer.parquet(self.path(name))
        return self.spark.read.parquet(self.path(name))

    def append(self, name: str, df: DataFrame) -> None:
        df.write.mode("append").parquet(self.path(name))

    # --- appends that are all there or not there ---

    def _files(self):
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        at = lambda path: jvm.org.apache.hadoop.fs.Path(path)
        return at(self.base).getFileSystem(conf), at

    def commit(self, name: str, df: DataFrame, key: str | None = None) -> bool:
        """Add rows to a log of commits; False if a commit of this ``key`` is published already (nothing is written then).

        Rows are written to a folder of their own first and published by an empty marker file that names it, made in one
        step. Readers only see published folders, so a writer that dies in between leaves nothing behind that counts, and
        a job that is run again under its key never counts twice.
        """
        key = key or uuid.uuid4().hex
        if not re.fullmatch(r"[\w.=-]+", key):
            raise ValueError("a key is made of letters, digits, '_', '.', '=' and '-'")
        fs, at = self._files()
        marker = at(f"{self.path(name)}.log/{key}")
        if fs.exists(marker):
            return False
        df.write.mode("overwrite").parquet(f"{self.path(name)}.commits/{key}")  # what a dead writer of this key left is replaced
        fs.create(marker, False).close()
        return True

    def committed(self, name: str, required: list[str] | None = None) -> DataFrame | None:
        """The rows of all published commits; None if there are none."""
        fs, at = self._files()
        log = at(f"{self.path(name)}.log")
        if not fs.exists(log):
            return None
        keys = sorted(f.getPath().getName() for f in fs.listStatus(log))
        paths = [f"{self.path(name)}.commits/{k}" for k in keys if not k.startswith((".", "_"))]
        return require_columns(self.spark.read.option("mergeSchema", True).parquet(*paths), required or []) if paths else None

    def read(self, name: str, required: list[str] | None = None, optional: bool = False) -> DataFrame | None:
        """The table; a missing one raises, or is None if ``optional``. Missing columns raise."""
        try:
            df = self.spark.read.parquet(self.path(name))
        except AnalysisException as e:
            if optional and e.getCondition() == "PATH_NOT_FOUND":
                return None
            raise
        return require_columns(df, required or [])

    def first_of(self, names: list[str]) -> DataFrame | None:
        """The first table of a list of candidates that exists."""
        for name in names:
            if (df := self.read(name, optional=True)) is not None:
                return df
        return None

    def inputs_report(self, names: list[str]) -> DataFrame:
        """(name, found, n_columns): which tables are there; footers only are read."""
        found = [(n, df is not None, len(df.columns) if df is not None else None) for n in names for df in [self.read(n, optional=True)]]
        return self.spark.createDataFrame(found, "name string, found boolean, n_columns int")

    def trajectory_info(self, name: str, keys: list[str]) -> DataFrame:
        """(keys, n_frames) of a table of frames."""
        return self.read(name, keys).groupBy(*keys).agg(F.count("*").alias("n_frames"))

    def import_csv(self, name: str, schema: str) -> DataFrame:
        """A CSV export read back under a schema; columns are matched by header, empty cells are NULL."""
        return self.spark.read.option("header", True).option("enforceSchema", False).schema(schema).csv(self.path(name))

    def export_csv(self, name: str, df: DataFrame) -> None:
        df.write.mode("overwrite").option("header", True).csv(self.path(name))

    def export_json(self, name: str, df: DataFrame) -> None:
        df.write.mode("overwrite").json(self.path(name))
