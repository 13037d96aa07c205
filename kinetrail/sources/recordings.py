"""Recordings to tables: archives, manifests, embedded metadata, and HDF5 files where the reader is installed.

Files are found and read by executors, a file (or archive member) a task row; one that fails becomes a row with its
error and never stops the job. The canonical interchange is Parquet: ``samples`` and ``frames`` (see the schemas).
"""

from __future__ import annotations

import io
import json
import tarfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetrail.functions.columns import base_name, file_stem, is_archive, is_uuid

SAMPLES = "trajectory_id string, scene_id string, kind string, group string, seq int, ts_ns long, position array<double>, velocity array<double>"
FRAMES = "trajectory_id string, camera string, stream string, frame_idx int, ts_ns long, bytes binary"
METADATA = (
    "resource_info struct<id string, owner string, region string, created_at string>, equipment_info struct<manufacturer string, model string, sn string>, "
    "collected_at string, collection_duration_in_ms long, duration_in_ms long, file_size_in_bytes long, _corrupt_record string"
)
#: The largest file that is read as one value; Spark refuses larger ones on the executors.
MAX_BYTES = 2**31 - 1


def find_files(spark: SparkSession, base: str, suffixes: tuple[str, ...] = (".h5", ".tar", ".tar.gz", ".tgz", ".tar.bz2", ".tbz2")) -> DataFrame:
    """(path, length) of all files below ``base`` with one of the endings, whatever their case. File contents aren't read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base).select("path", "length")
    low = F.lower("path")
    keep = F.lit(False)
    for s in suffixes:
        keep = keep | low.endswith(s)
    return found.where(keep)


def manifest(files: DataFrame, scene: str, task: str, object_id: str | None = None) -> DataFrame:
    """One row a file: ids from its name, and the recording's literals."""
    return files.select(
        file_stem("path").alias("trajectory_id"), base_name("path").alias("file_name"), F.col("path").alias("file_path"), F.lit(scene).alias("scene_id"),
        F.lit(task).alias("task_name"), F.lit(object_id).cast("string").alias("object_id"), is_uuid(file_stem("path")).alias("is_uuid_file_name"),
    )


def archive_members(spark: SparkSession, base: str, suffix: str = ".h5") -> DataFrame:
    """(archive, member, content, error) of the regular files in all archives below ``base`` whose names end so.

    Members' names lose empty, ``.`` and ``..`` parts. An unreadable archive, or one over ``MAX_BYTES``, is one row with its error.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base).where(is_archive("path"))
    raw = files.where(F.col("length") <= MAX_BYTES).select("path", "content")  # the length is known before a file is read

    def expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                try:
                    with tarfile.open(fileobj=io.BytesIO(content)) as archive:
                        for m in archive:
                            if m.isfile() and m.name.lower().endswith(suffix):
                                parts = [p for p in m.name.replace("\\", "/").split("/") if p not in ("", ".", "..")]
                                yield pd.DataFrame([(path, "/".join(parts), archive.extractfile(m).read(), None)], columns=["archive", "member", "content", "error"])
                except (tarfile.TarError, OSError, EOFError) as e:
                    yield pd.DataFrame([(path, None, None, str(e))], columns=["archive", "member", "content", "error"])

    none = F.lit(None)
    large = files.where(F.col("length") > MAX_BYTES).select(F.col("path").alias("archive"), none.cast("string").alias("member"), none.cast("binary").alias("content"), F.lit(f"over {MAX_BYTES} bytes").alias("error"))
    return raw.mapInPandas(expand, "archive string, member string, content binary, error string").union(large)


def parse_metadata(df: DataFrame, column: str = "metadata") -> DataFrame:
    """``df`` with the declared metadata fields as columns; text that is no JSON object stays in raw_metadata_text."""
    df = df.withColumn("_m", F.from_json(F.col(column), METADATA, {"columnNameOfCorruptRecord": "_corrupt_record", "mode": "PERMISSIVE"}))
    field = lambda x: F.col(f"_m.{x}")
    return df.withColumns({
        "resource_id": field("resource_info.id"), "owner": field("resource_info.owner"), "region": field("resource_info.region"), "created_at": field("resource_info.created_at"),
        "manufacturer": field("equipment_info.manufacturer"), "equipment_model": field("equipment_info.model"), "equipment_sn": field("equipment_info.sn"),
        "collected_at": field("collected_at"), "collection_duration_in_ms": field("collection_duration_in_ms"), "duration_in_ms": field("duration_in_ms"),
        "file_size_in_bytes": field("file_size_in_bytes"), "raw_metadata_text": F.when(field("_corrupt_record").isNotNull(), F.col(column)),
    }).drop("_m")


def metadata_summary(samples: DataFrame, frames: DataFrame) -> DataFrame:
    """Per trajectory: group names by kind, the widest position of each, and the frame count of each camera stream."""
    groups = samples.groupBy("trajectory_id").agg(
        F.array_sort(F.collect_set(F.when(F.col("kind") == "action", F.col("group")))).alias("action_groups"),
        F.array_sort(F.collect_set(F.when(F.col("kind") == "state", F.col("group")))).alias("state_groups"),
        F.max(F.size("position")).alias("max_dim"),
    )
    cameras = frames.groupBy("trajectory_id", "camera", "stream").agg(F.count("*").alias("n")).groupBy("trajectory_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.concat_ws("_", "camera", "stream", F.lit("n")), "n")))).alias("camera_counts")
    )
    return groups.join(cameras, "trajectory_id", "left")


def read_hdf5(files: DataFrame) -> DataFrame:
    """(path, name, shape, dtype, value, error): every dataset of HDF5 files given as (path, content), as JSON text.

    Needs ``h5py`` on the executors; without it each file gives a row with the error.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["path", "name", "shape", "dtype", "value", "error"]
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                rows: list[tuple] = []
                try:
                    import h5py

                    def visit(name, item, rows=rows, path=path):
                        if isinstance(item, h5py.Dataset):
                            x = item[()]
                            text = json.dumps(x.tolist() if hasattr(x, "tolist") else str(x), default=lambda b: b.decode("utf-8", "replace"))
                            rows.append((path, name, [int(s) for s in item.shape], str(item.dtype), text, None))

                    with h5py.File(io.BytesIO(content), "r") as f:
                        f.visititems(visit)
                except Exception as e:  # one bad file is one row
                    rows = [(path, None, None, None, None, f"{type(e).__name__}: {e}")]
                yield pd.DataFrame(rows, columns=columns)

    return files.select("path", "content").mapInPandas(read, "path string, name string, shape array<int>, dtype string, value string, error string")


def find_datasets(datasets: DataFrame, terms: list[str]) -> DataFrame:
    """Datasets whose name holds one of the terms, whatever its case."""
    hit = F.lit(False)
    for t in terms:
        hit = hit | F.contains(F.lower("name"), F.lit(t.lower()))
    return datasets.where(hit)


def flatten_array(df: DataFrame, value: str, shape: str) -> DataFrame:
    """(…, i, v, original_shape): nested arrays of up to two levels as one row an element, with their shape."""
    kind = df.schema[value].dataType.simpleString()
    flat = F.flatten(value) if kind.startswith("array<array<") else F.col(value)
    keep = [c for c in df.columns if c not in (value, shape)]
    return df.select(*keep, F.posexplode(flat).alias("i", "v"), F.col(shape).alias("original_shape"))


def image_features(frames: DataFrame, by: list[str], image: str = "bytes", bins: int = 4) -> DataFrame:
    """Per group and channel: mean, std and histogram shares of pixels; needs Pillow, undecodable frames don't count.

    Each frame is reduced to sums where it's decoded; the rest is one aggregate.
    """
    width = 256 // bins

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                try:
                    from PIL import Image

                    x = np.asarray(Image.open(io.BytesIO(row[image])).convert("RGB"), float)
                except Exception:  # no decoder or no image: missing
                    continue
                for k, name in enumerate("rgb"):
                    c = x[..., k].ravel()
                    out.append((*[row[b] for b in by], name, len(c), c.sum(), (c * c).sum(), np.bincount((c // width).astype(int), minlength=bins)[:bins].tolist()))
            yield pd.DataFrame(out, columns=[*by, "channel", "n", "s", "q", "h"])

    keys = ", ".join(f"{b} {frames.schema[b].dataType.simpleString()}" for b in by)
    parts = frames.select(*by, image).mapInPandas(measure, f"{keys}, channel string, n long, s double, q double, h array<long>")
    n, s, q = F.sum("n"), F.sum("s"), F.sum("q")
    return parts.groupBy(*by, "channel").agg(
        (s / n).alias("mean"), F.sqrt(F.greatest(q / n - (s / n) ** 2, F.lit(0.0))).alias("std"), F.array(*[F.sum(F.col("h")[i]) / n for i in range(bins)]).alias("hist")
    )
