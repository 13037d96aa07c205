"""Recording files to typed tables, against the arrays that were stored; NumPy archives stand for HDF5, whose reader isn't here."""

import io
import json
import tarfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinetrail.plans import stages
from kinetrail.sources import records as rec
from kinetrail.sources.store import StageStore

META = {"resource_info": {"id": "r1", "owner": "o"}, "equipment_info": {"model": "m"}, "duration_in_ms": 70, "extra": [1]}


def arrays(seed: int = 0):
    rng = np.random.default_rng(seed)
    arm = rng.normal(size=(5, 3))
    arm[2, 1] = np.nan
    return {
        "joints/action/arm/position": arm,
        "joints/action/arm/velocity": rng.normal(size=(4, 3)),
        "joints/action/arm/timestamp": np.arange(5) * 10,
        "joints/state/arm/position": rng.normal(size=(5, 3)),
        "joints/state/effector/position": rng.normal(size=5),
        "cameras/head/color/data": np.array([b"\x89PNG1", b"\xff\xd82", b"x3"]),
        "cameras/head/color/timestamp": np.array([5, 15]),
        "cameras/head/depth/data": np.arange(6, dtype=np.uint8).reshape(2, 3),
        "cameras/wrist/color/timestamp": np.array([7]),
        "metadata.json": np.array(json.dumps(META)),
        "attributes": np.array(json.dumps({"": {"version": 3}, "joints/action/arm": {"unit": "rad"}, "cameras/side": {}})),
    }


def npz(content: dict) -> bytes:
    out = io.BytesIO()
    np.savez(out, **content)
    return out.getvalue()


@pytest.fixture()
def folder(tmp_path):
    raw = tmp_path / "raw" / "day"
    raw.mkdir(parents=True)
    (raw / "one.npz").write_bytes(npz(arrays()))
    (raw / "bad.NPZ").write_bytes(b"no archive")
    (raw / "empty.npz").write_bytes(npz({}))
    with tarfile.open(raw / "more.tar", "w") as tar:
        content = npz(arrays(1))
        info = tarfile.TarInfo("./in/two.npz")
        info.size = len(content)
        tar.addfile(info, io.BytesIO(content))
    (raw / "broken.tar").write_bytes(b"x")
    return tmp_path


@pytest.mark.filterwarnings("ignore")
def test_ingest(spark, folder):
    store = StageStore(spark, str(folder / "store"))
    for _ in range(2):  # reading a scene again replaces its rows
        stages.ingest(store, str(folder / "raw"), "S1", "pick", opener=rec.open_npz, suffix=".npz")
    given = {"one": arrays(), "two": arrays(1)}
    samples = store.read("samples").collect()
    assert len(samples) == 2 * 15
    for name, kind, group in [(n, *g) for n in given for g in (("action", "arm"), ("state", "arm"), ("state", "effector"))]:
        rows = sorted((r for r in samples if (r["trajectory_id"], r["kind"], r["group"]) == (name, kind, group)), key=lambda r: r["seq"])
        want = given[name][f"joints/{kind}/{group}/position"].reshape(5, -1)
        assert [r["seq"] for r in rows] == list(range(5))
        assert [[None if np.isnan(v) else v for v in row] for row in want.tolist()] == [r["position"] for r in rows]
        if (kind, group) == ("action", "arm"):
            assert [r["ts_ns"] for r in rows] == [0, 10, 20, 30, 40]
            assert [r["velocity"] for r in rows] == [*given[name]["joints/action/arm/velocity"].tolist(), None]
        else:
            assert {r["ts_ns"] for r in rows} == {None} and {r["velocity"] for r in rows} == {None}
    frames = store.read("frames").where("trajectory_id = 'one'").orderBy("camera", "stream", "frame_idx").collect()
    got = [(r["camera"], r["stream"], r["frame_idx"], r["ts_ns"], r["bytes"] and bytes(r["bytes"])) for r in frames]
    assert got == [
        ("head", "color", 0, 5, b"\x89PNG1"), ("head", "color", 1, 15, b"\xff\xd82"), ("head", "color", 2, None, b"x3"),
        ("head", "depth", 0, None, bytes([0, 1, 2])), ("head", "depth", 1, None, bytes([3, 4, 5])), ("wrist", "color", 0, 7, None),
    ]
    about = {r["trajectory_id"]: r for r in store.read("raw_metadata").collect()}
    assert set(about) == {"one", "two"} and store.read("manifest").count() == 2
    one = about["one"]
    assert (one["action_groups"], one["state_groups"], one["camera_names"]) == (["arm"], ["arm", "effector"], ["head", "side", "wrist"])
    assert one["shapes"] == {"arm_action": [5, 3], "arm_state": [5, 3], "effector_state": [5]} and one["dims"] == {"arm_action": 3, "arm_state": 3}
    assert one["camera_counts"] == {"head_color_n": 3, "head_depth_n": 2, "side_color_n": 0, "side_depth_n": 0, "wrist_color_n": 0, "wrist_depth_n": 0}
    assert (one["resource_id"], one["equipment_model"], one["duration_in_ms"], one["owner"], one["region"]) == ("r1", "m", 70, "o", None)
    errors = store.read("recording_errors").collect()
    assert sorted(r["path"].rsplit("/", 1)[1] for r in errors) == ["bad.NPZ", "broken.tar"] and all(r["text"] for r in errors)
    attributes = store.spark.read.parquet(store.path("records/S1")).where("part = 'attribute'").where(F.col("path").endswith("one.npz"))
    assert {r["name"]: json.loads(r["text"]) for r in attributes.collect()} == {"": {"version": 3}, "joints/action/arm": {"unit": "rad"}}


def test_a_dataset_that_fails_leaves_the_rest():
    class Broken:
        def __getitem__(self, key):
            raise OSError("bad block")

    given = {"joints/state/arm/position": Broken(), "joints/state/arm/timestamp": np.arange(2), "metadata.json": np.array([b"{\xff"])}
    got = list(rec.file_records("p", rec.Opened(given, {"": {"a": np.float32(2), "b": np.array([b"x"])}})))
    assert [r["part"] for r in got] == ["attribute", "metadata", "group", "state", "state", "error"]
    assert json.loads(got[0]["text"]) == {"a": 2.0, "b": ["x"]} and got[1]["text"] == "{�" and got[2]["shape"] is None
    assert got[-1]["name"] == "joints/state/arm/position" and "bad block" in got[-1]["text"]


def test_image_bytes():
    assert rec.image_bytes(None) is None and rec.image_bytes(3) is None and rec.image_bytes(b"x") == [b"x"]
    mixed = np.empty(4, object)
    mixed[:] = [None, b"a", np.array([1, 2], np.uint8), "text"]
    assert rec.image_bytes(mixed) == [b"", b"a", b"\x01\x02", b""]


def test_readers_that_are_missing_give_errors(spark):
    files = spark.createDataFrame([("a.h5", bytearray(b"x")), ("b.h5", None)], "path string, content binary")
    assert {(r["path"], r["part"], bool(r["text"])) for r in rec.read_records(files).collect()} == {("a.h5", "error", True), ("b.h5", "error", True)}
    assert {(r["path"], bool(r["error"])) for r in rec.read_pandas_stores(files).collect()} == {("a.h5", True), ("b.h5", True)}


def test_frames_as_files(spark, tmp_path):
    rows = [("t/1", "head", "color", i, None if i == 3 else 10 * i, b) for i, b in enumerate([b"no", b"\x89PNG1", b"\xff\xd82", b"", b"x"])]
    frames = spark.createDataFrame(rows, "trajectory_id string, camera string, stream string, frame_idx int, ts_ns long, bytes binary")
    some = rec.frame_range(frames, -5, 3)
    assert [r["image_name"] for r in some.orderBy("frame_idx").collect()] == ["img_000000_0", "img_000001_10", "img_000002_20", "img_000003_none"]
    assert rec.frame_range(frames, 3, 2).count() == 0 and rec.frame_range(frames, 4, 99).count() == 1
    for _ in range(2):
        rec.export_images(rec.frame_range(frames, 1, 3), str(tmp_path))
    found = {str(p.relative_to(tmp_path)): p.read_bytes() for p in tmp_path.rglob("*") if p.is_file()}
    assert found == {"t_1/head/color/img_000001_10.png": b"\x89PNG1", "t_1/head/color/img_000002_20.jpg": b"\xff\xd82"}


def test_outline(spark):
    texts = ['{"a": {"b": {"c": 1}}, "s": "x"}', '{"a": {"b": 2.5}, "s": null}', "[1]", "{broken", None, "7"]
    got = {(r["path"], r["kind"]): (r["n"], r["example"]) for r in rec.metadata_outline(spark.createDataFrame([(t,) for t in texts], "metadata string")).collect()}
    assert got == {
        ("", "array"): (1, None), ("", "unreadable"): (1, None), ("", "bigint"): (1, "7"), ("a", "object"): (2, None), ("a.b", "object"): (1, None),
        ("a.b", "decimal"): (1, "2.5"), ("a.b.c", "bigint"): (1, "1"), ("s", "string"): (1, "x"), ("s", "void"): (1, None),
    }
    raw = spark.createDataFrame([(bytearray(b'{"k": true}'),), (bytearray(b"\xff"),)], "metadata binary")
    assert {(r["path"], r["kind"]) for r in rec.metadata_outline(raw, depth=1).collect()} == {("k", "boolean"), ("", "unreadable")}
