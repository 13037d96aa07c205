"""What the text operators share: staging in the cluster's shared folder and small column helpers."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the contracts define it, and the upper-case letters that they lower.
WS = "\t\n\x0b\x0c\r "
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` where the cluster names one.

    Only a local session without that setting (tests, a laptop) gets a temporary folder of its own; on a cluster,
    executors wouldn't see each other's files there.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="kinetrail-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


#: Tables that :func:`stage` has written, by the innermost :func:`tidied` block around it.
_written: list[list[str]] = []


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Lineage is cut there: later steps survive lost executors without recomputing what came before, and a
    result read by several consumers is computed once. Within a :func:`tidied` block the table goes when the block ends.
    """
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_dir(spark)}/kinetrail/{label}-{uuid.uuid4().hex}"
    if _written:
        _written[-1].append(path)
    df.write.parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    made.staged_at = path
    return made


@contextmanager
def tidied() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes the tables staged within the block when it ends, but those that the yielded function is given.

    What a block hands on must be staged and kept: a plan that still reads a deleted table fails. Kept tables belong to
    the block around this one, if there is one.
    """
    keep: list[DataFrame] = []

    def kept(df: DataFrame) -> DataFrame:
        keep.append(df)
        return df

    _written.append([])
    try:
        yield kept
    finally:
        paths, stay = _written.pop(), {df.staged_at for df in keep}
        if _written:
            _written[-1] += [p for p in paths if p in stay]
        spark = SparkSession.getActiveSession()
        for path in [p for p in paths if p not in stay] if spark else []:
            delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    """Remove a table that :func:`stage` wrote, in whatever store it lies."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


_held: dict[tuple[str, str], object] = {}


def held(operator: str, path: str, make):
    """What a worker keeps between tasks, made from a file: of one operator and file at a time.

    Workers serve one stage after the other; what an earlier stage's operator remembered would lie beside the next one's.
    """
    if (operator, path) not in _held:
        _held.clear()
        _held[operator, path] = make(path)
    return _held[operator, path]


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most 2,000 rows or about 8 MB, unless the session says otherwise.

    At Spark's defaults a batch of long texts takes 64 MB, several times over (the executor's direct memory, its
    growing copy, the worker's), in every running task.
    """
    for key, usual, small in (("maxRecordsPerBatch", "10000", "2000"), ("maxBytesPerBatch", "67108864b", "8m")):
        if spark.conf.get(key := f"spark.sql.execution.arrow.{key}", usual) == usual:
            spark.conf.set(key, small)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower A-Z only. ``lower`` does the same on pure ASCII and is much faster, so it takes those texts."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def crc32_mod(c: Column, n: int) -> Column:
    """CRC-32 of an id's decimal text, modulo ``n``; null ids count as the empty string."""
    return F.pmod(F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have (names compare without case)."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name = f"_{name}"
    return name


def quoted(name: str) -> Column:
    return F.col("`" + re.sub("`", "``", name) + "`")
