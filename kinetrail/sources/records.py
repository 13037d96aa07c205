"""Recording files as records: an executor opens a file once, and every typed table is a selection of what it gave.

A record's ``part`` says which columns it fills. ``action`` and ``state``: a step of a joint group (name, i, ts_ns, position,
velocity). ``color`` and ``depth``: a camera's frame (name, i, ts_ns, bytes). ``group``: a joint group and its position's
shape. ``camera``: a camera and its numbers of colour and depth frames as shape. ``attribute``: an object's attributes as
JSON text. ``metadata``: the embedded text. ``error``: what couldn't be read, by name; the rest of the file is still read.

Groups, datasets and timestamps may be missing: what isn't there is NULL. Datasets of a group that differ in length end
in NULLs. The small parts (group, camera, metadata) are stored apart from steps and images, so summaries never read these.
"""

from __future__ import annotations

import io
import json
import re
from collections.abc import Callable, Iterator, Mapping
from itertools import islice
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinetrail.functions.columns import base_name, file_stem, text_of
from kinetrail.sources.recordings import MAX_BYTES, archive_members, parse_metadata

RECORDS = "path string, part string, name string, i int, ts_ns long, position array<double>, velocity array<double>, bytes binary, shape array<int>, text string"
_ARROW = pa.schema([
    ("path", pa.string()), ("part", pa.string()), ("name", pa.string()), ("i", pa.int32()), ("ts_ns", pa.int64()), ("position", pa.list_(pa.float64())),
    ("velocity", pa.list_(pa.float64())), ("bytes", pa.binary()), ("shape", pa.list_(pa.int32())), ("text", pa.string()),
])
#: Rows that leave a worker at once: steps, and frames with their bytes.
STEPS_AT_ONCE, FRAMES_AT_ONCE = 2000, 16


class Opened(NamedTuple):
    """A file's datasets by name (each is read by ``[()]``) and its objects' attributes by name; "" is the root."""

    datasets: Mapping
    attributes: Mapping


def open_hdf5(content: bytes) -> Opened:
    """An HDF5 file; needs ``h5py``."""
    import h5py

    root = h5py.File(io.BytesIO(content), "r")
    datasets, attributes = {}, {"": dict(root.attrs)}

    def visit(name, item):
        attributes[name] = dict(item.attrs)
        if isinstance(item, h5py.Dataset):
            datasets[name] = item

    root.visititems(visit)
    return Opened(datasets, attributes)


def open_npz(content: bytes) -> Opened:
    """A NumPy archive whose entries carry the datasets' names; an entry ``attributes`` may hold all attributes as JSON text."""
    arrays = np.load(io.BytesIO(content), allow_pickle=False)
    attributes = json.loads(str(arrays["attributes"][()])) if "attributes" in arrays else {}
    return Opened({n: _Entry(arrays, n) for n in arrays.files if n != "attributes"}, attributes)


class _Entry(NamedTuple):
    arrays: Mapping
    name: str

    def __getitem__(self, key):
        return self.arrays[self.name]


def plain(value):
    """A value for JSON: bytes as text, arrays as lists, NumPy scalars as Python's."""
    if isinstance(value, (bytes, bytearray)):
        return bytes(value).decode("utf-8", "replace")
    if isinstance(value, (np.ndarray, np.generic)):
        return plain(value.tolist())
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    return value if value is None or isinstance(value, (str, int, float, bool)) else str(value)


def image_bytes(data) -> list[bytes] | None:
    """The frames of an image dataset as bytes: a missing or unreadable one is empty, one value is one frame."""
    if data is None:
        return None
    if isinstance(data, (bytes, bytearray)):
        return [bytes(data)]
    if not isinstance(data, np.ndarray) or data.ndim == 0:
        return None

    def one(item) -> bytes:
        if isinstance(item, (bytes, bytearray)):
            return bytes(item)
        return item.tobytes() if isinstance(item, (np.ndarray, np.generic)) and item.dtype != object else b""

    return [one(item) for item in data]


def _vectors(x) -> list[list[float]] | None:
    return None if x is None else np.asarray(x, float).reshape(len(x) if np.ndim(x) else 1, -1).tolist()


def _longest(*columns: list | None) -> Iterator[tuple]:
    n = max((len(c) for c in columns if c is not None), default=0)
    return ((i, *[c[i] if c is not None and i < len(c) else None for c in columns]) for i in range(n))


def file_records(path: str, opened: Opened) -> Iterator[dict]:
    """All records of an opened file."""
    sets, attributes = opened
    errors: list[dict] = []

    def load(name: str):
        if name not in sets:
            return None
        try:
            return sets[name][()]
        except Exception as e:  # a dataset that can't be read is a row; the others are still read
            errors.append({"part": "error", "name": name, "text": f"{type(e).__name__}: {e}"})
            return None

    def stamps(name: str):
        x = load(name)
        return None if x is None else np.atleast_1d(np.asarray(x)).astype(np.int64).tolist()

    for name in sorted(attributes):
        if attributes[name]:
            yield {"part": "attribute", "name": name, "text": json.dumps({k: plain(v) for k, v in attributes[name].items()}, ensure_ascii=False)}
    if (about := load("metadata.json")) is not None:
        about = about.item() if isinstance(about, np.ndarray) and about.size == 1 else about
        if isinstance(about, (str, bytes)):
            yield {"part": "metadata", "text": plain(about)}
    names = {*sets, *attributes}
    for group in sorted({m[0] for n in names if (m := re.match("joints/(?:action|state)/[^/]+", n))}):
        _, kind, name = group.split("/")
        position, velocity = load(f"{group}/position"), load(f"{group}/velocity")
        yield {"part": "group", "name": f"{kind}/{name}", "shape": None if position is None else [int(s) for s in np.shape(position)]}
        for i, ts, p, v in _longest(stamps(f"{group}/timestamp"), _vectors(position), _vectors(velocity)):
            yield {"part": kind, "name": name, "i": i, "ts_ns": ts, "position": p, "velocity": v}
    for group in sorted({m[0] for n in names if (m := re.match("cameras/[^/]+", n))}):
        name, counts = group.split("/")[1], []
        for kind in ("color", "depth"):
            frames = image_bytes(load(f"{group}/{kind}/data"))
            counts.append(len(frames or []))
            for i, ts, b in _longest(stamps(f"{group}/{kind}/timestamp"), frames):
                yield {"part": kind, "name": name, "i": i, "ts_ns": ts, "bytes": b}
        yield {"part": "camera", "name": name, "shape": counts}
    yield from errors


def read_records(files: DataFrame, opener: Callable[[bytes], Opened] = open_hdf5) -> DataFrame:
    """The records of files given as (path, content). A file that can't be opened, or has no content, is one error record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                try:
                    rows = file_records(path, opener(content.as_py()))
                    for row in rows:
                        most = FRAMES_AT_ONCE if row["part"] in ("color", "depth") else STEPS_AT_ONCE
                        some = [{**r, "path": path} for r in (row, *islice(rows, most - 1))]
                        yield pa.RecordBatch.from_pylist(some, _ARROW)
                except Exception as e:  # one bad file never stops the others
                    yield pa.RecordBatch.from_pylist([{"path": path, "part": "error", "text": f"{type(e).__name__}: {e}"}], _ARROW)

    return files.select("path", "content").mapInArrow(run, RECORDS)


def find_contents(spark, base: str, suffix: str = ".h5") -> tuple[DataFrame, DataFrame]:
    """((path, content), (path, text)): files below ``base`` and members of its archives that end so; and those that can't be read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base).where(F.lower("path").endswith(suffix))
    members = archive_members(spark, base, suffix)
    small = files.where(F.col("length") <= MAX_BYTES).select("path", "content")
    inside = members.where("error is null").select(F.concat_ws("/", "archive", "member").alias("path"), "content")
    bad = files.where(F.col("length") > MAX_BYTES).select("path", F.lit(f"over {MAX_BYTES} bytes").alias("text"))
    return small.union(inside), bad.union(members.where("error is not null").select("archive", "error"))


# --- typed tables of records ---


def without_nan(x: str) -> Column:
    return F.transform(x, lambda v: F.when(~F.isnan(v), v))


def samples_of(records: DataFrame, scene: str | Column) -> DataFrame:
    """``samples``: a row a step of a joint group; missing numbers are NULL."""
    steps = records.where(F.col("part").isin("action", "state"))
    scene = F.lit(scene) if isinstance(scene, str) else scene
    return steps.select(
        file_stem("path").alias("trajectory_id"), scene.alias("scene_id"), F.col("part").alias("kind"), F.col("name").alias("group"), F.col("i").alias("seq"), "ts_ns",
        without_nan("position").alias("position"), without_nan("velocity").alias("velocity"),
    )


def frames_of(records: DataFrame, scene: str | Column) -> DataFrame:
    """``frames``: a row a camera's frame; one without data (only a timestamp) has no bytes."""
    shots = records.where(F.col("part").isin("color", "depth"))
    scene = F.lit(scene) if isinstance(scene, str) else scene
    return shots.select(file_stem("path").alias("trajectory_id"), scene.alias("scene_id"), F.col("name").alias("camera"), F.col("part").alias("stream"), F.col("i").alias("frame_idx"), "ts_ns", "bytes")


def recording_summary(records: DataFrame) -> DataFrame:
    """One row a file: names of joint groups and cameras, position shapes and widths by ``group_kind``, frame counts by
    ``camera_stream_n``, and the metadata's declared fields.

    A width is there for positions of two dimensions only. Steps and images aren't read.
    """
    rows = records.where(F.col("part").isin("group", "camera", "metadata"))
    named = F.split("name", "/")
    kind, group = named[0], named[1]
    label = F.concat_ws("_", group, kind)
    is_group, is_camera = F.col("part") == "group", F.col("part") == "camera"
    count = lambda stream, k: F.collect_list(F.when(is_camera, F.struct(F.concat_ws("_", "name", F.lit(stream), F.lit("n")), F.col("shape")[k])))
    found = rows.groupBy("path").agg(
        *[F.array_sort(F.collect_set(F.when(is_group & (kind == k), group))).alias(f"{k}_groups") for k in ("action", "state")],
        F.array_sort(F.collect_set(F.when(is_camera, F.col("name")))).alias("camera_names"),
        F.map_from_entries(F.array_sort(F.collect_list(F.when(is_group, F.struct(label, "shape"))))).alias("shapes"),
        F.map_from_entries(F.array_sort(F.collect_list(F.when(is_group & (F.size("shape") == 2), F.struct(label, F.col("shape")[1]))))).alias("dims"),
        F.map_from_entries(F.array_sort(F.concat(count("color", 0), count("depth", 1)))).alias("camera_counts"),
        F.max("text").alias("metadata"),
    )
    found = parse_metadata(found).drop("metadata")
    return found.select(file_stem("path").alias("trajectory_id"), base_name("path").alias("file_name"), "*")


def frame_range(frames: DataFrame, first: int, last: int, place: str = "frame_idx", stamp: str = "ts_ns") -> DataFrame:
    """Frames ``first`` to ``last``, both included, with a file name; what lies outside a camera's frames gives no row.

    A filter on a column, so Parquet readers skip what lies outside.
    """
    kept = frames.where(F.col(place).between(max(0, first), last))
    return kept.withColumn("image_name", F.format_string("img_%06d_%s", F.col(place).cast("long"), F.coalesce(F.col(stamp).cast("string"), F.lit("none"))))


def export_images(frames: DataFrame, base: str) -> None:
    """Write the bytes of frames (trajectory_id, camera, stream, image_name, bytes) as files below ``base``, from the executors.

    ``base`` is a path or address that pyarrow's file systems know. Names follow the content (.png, .jpg, else .bin); a
    task that runs again writes the same files again. Empty frames have no file.
    """

    def write(rows) -> None:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(base if "://" in base else f"file://{base}")
        for r in rows:
            folder = "/".join([root, *[re.sub(r"[^\w.=-]|^\.+$", "_", str(r[c])) for c in ("trajectory_id", "camera", "stream")]])
            ending = ".png" if r["bytes"][:4] == b"\x89PNG" else ".jpg" if r["bytes"][:2] == b"\xff\xd8" else ".bin"
            system.create_dir(folder, recursive=True)
            with system.open_output_stream(f"{folder}/{r['image_name']}{ending}") as out:
                out.write(bytes(r["bytes"]))

    frames.where(F.length("bytes") > 0).select("trajectory_id", "camera", "stream", "image_name", "bytes").foreachPartition(write)


def metadata_outline(df: DataFrame, column: str = "metadata", depth: int = 4) -> DataFrame:
    """(path, kind, n, example): which keys JSON texts hold, to ``depth`` levels, with the kind of their values.

    Texts (or bytes) that are no JSON object are counted under the path "" with the kind of what they are; ``unreadable``
    if they are no JSON at all. NULLs aren't counted. The example is the smallest value as text, for scalars only.
    """
    spark = df.sparkSession
    text = text_of(column) if df.schema[column].dataType.simpleString() == "binary" else F.col(column)
    level = df.where(F.col(column).isNotNull()).select(F.lit("").alias("path"), F.try_parse_json(text).alias("v"))
    levels = [level]
    for _ in range(depth):
        inner = level.where(F.schema_of_variant("v").startswith("OBJECT")).lateralJoin(spark.tvf.variant_explode(F.col("v").outer()))
        level = inner.select(F.concat_ws(".", F.nullif("path", F.lit("")), "key").alias("path"), F.col("value").alias("v"))
        levels.append(level)
    every = levels[0].where(~F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False)))
    for one in levels[1:]:
        every = every.union(one)
    kind = F.coalesce(F.lower(F.regexp_extract(F.schema_of_variant("v"), "^[A-Z]+", 0)), F.lit("unreadable"))
    value = F.when(~kind.isin("object", "array", "void", "unreadable"), F.try_variant_get("v", "$", "string"))
    return every.select("path", kind.alias("kind"), value.alias("value")).groupBy("path", "kind").agg(F.count("*").alias("n"), F.min("value").alias("example"))


def read_pandas_stores(files: DataFrame) -> DataFrame:
    """(path, key, i, row, error): the tables that pandas wrote into HDF files given as (path, content), a JSON text a row.

    Keys that pandas can't read are left out; a file that it can't open is a row with its error. Needs ``tables``.
    """
    fields = pa.schema([("path", pa.string()), ("key", pa.string()), ("i", pa.int64()), ("row", pa.string()), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pandas as pd

        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                try:
                    with pd.HDFStore("store", mode="r", driver="H5FD_CORE", driver_core_backing_store=0, driver_core_image=content.as_py()) as store:
                        for key in store.keys():
                            try:
                                lines = store[key].to_json(orient="records", lines=True).splitlines()
                            except Exception:  # no table of pandas
                                continue
                            rows = [{"path": path, "key": key, "i": i, "row": line} for i, line in enumerate(lines)]
                            yield pa.RecordBatch.from_pylist(rows, fields)
                except Exception as e:  # one bad file never stops the others
                    yield pa.RecordBatch.from_pylist([{"path": path, "error": f"{type(e).__name__}: {e}"}], fields)

    return files.select("path", "content").mapInArrow(run, "path string, key string, i long, row string, error string")
