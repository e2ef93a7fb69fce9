"""Artifacts, files by key and appends: what a crash, a repeated task or a wrong order leaves."""

import json
import os

import pytest

from scriptorium.operators.scoring import LinearModel
from scriptorium.sources import artifacts as A
from scriptorium.sources import keyed as K

MODEL = LinearModel(("a", "b"), (0.5, 1.0), (1.0, 2.0), (0.3, -0.2), 0.1, 0.47)


@pytest.fixture
def rows(spark):
    return spark.createDataFrame([(k, float(k), 2.0 * k) for k in range(20)], "id long, a double, b double")


def published(spark, rows, path, model=MODEL, c=0.5, recorded_c=0.5, recorded=None, **more):
    scored = rows.select("id", model.score().alias("score"))
    A.publish(spark, path, model, c, recorded_c, scored, scored if recorded is None else recorded, "id", **more)


def test_artifacts_come_back_whole(spark, rows, tmp_path):
    path = f"file://{tmp_path}/deep/detector.json"
    with pytest.raises(FileNotFoundError):
        A.load(spark, path, MODEL.fields)
    published(spark, rows, path, version="v1", seed=42)
    assert A.load(spark, path, ["a", "b"]) == MODEL and A._body(spark, path)["version"] == "v1"
    for wrong in (["b", "a"], ["a"], ["a", "c"]):
        with pytest.raises(ValueError, match="order"):
            A.load(spark, path, wrong)
    other = LinearModel(("a", "b"), (0.0, 1.0), (1.0, 2.0), (0.3, -0.25), 0.1, 0.34)
    published(spark, rows, path, other)
    assert A.load(spark, path, ["a", "b"]) == other and [f for f in os.listdir(tmp_path / "deep") if not f.endswith(".crc")] == ["detector.json"]


def test_only_what_is_on_record_is_published(spark, rows, tmp_path):
    path = f"file://{tmp_path}/detector.json"
    from pyspark.sql import functions as F

    score = rows.select("id", MODEL.score().alias("score"))
    near = score.withColumn("score", F.round("score", 4))
    published(spark, rows, path, recorded=near)
    off = score.withColumn("score", F.col("score") + F.when(F.col("id") == 7, 1e-3).otherwise(0.0))
    for bad in ({"recorded_c": 0.501}, {"recorded": off}, {"recorded": score.where("id <> 3")}, {"recorded": score.union(score.limit(1))}, {"recorded": score.withColumn("score", F.lit(None).cast("double"))}):
        with pytest.raises(ValueError):
            published(spark, rows, path, LinearModel(("a", "b"), (0.5, 1.0), (1.0, 2.0), (0.3, -0.2), 0.1, 0.9), **bad)
        assert A.load(spark, path, ["a", "b"]) == MODEL


@pytest.mark.parametrize("step", ["_read", "_swap"])
def test_a_crash_leaves_the_old_artifact(spark, rows, tmp_path, monkeypatch, step):
    path = f"file://{tmp_path}/detector.json"
    published(spark, rows, path)

    def crash(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(A, step, crash)
        with pytest.raises(RuntimeError):
            published(spark, rows, path, LinearModel(("a", "b"), (0.0, 0.0), (1.0, 1.0), (9.0, 9.0), 0.0, 0.5))
    A._cached.cache_clear()
    assert A.load(spark, path, ["a", "b"]) == MODEL
    assert not [f for f in os.listdir(tmp_path) if ".new-" in f and not f.endswith(".crc")]


def test_one_file_a_key(spark, tmp_path):
    path = f"{tmp_path}/prompts"
    d = spark.createDataFrame([("Cats & dogs?", 2), ("Cats & dogs?", 1), ("Cats - dogs!", 3), ("ü", 4), (None, 5)], "prompt string, n int").repartition(3)
    K.write_files(d, path, "prompt", "n")
    files = {f: [json.loads(x) for x in open(f"{path}/{f}")] for f in os.listdir(path)}
    assert len(files) == 4 and all(f.endswith(".json") for f in files)
    assert sorted([x["n"] for x in v] for v in files.values()) == [[1, 2], [3], [4], [5]]
    K.write_files(d.where("n = 3").withColumn("n", d.n * 10), path, "prompt")
    again = {f: [json.loads(x) for x in open(f"{path}/{f}")] for f in os.listdir(path)}
    assert again.keys() == files.keys() and sorted(x["n"] for v in again.values() for x in v) == [1, 2, 4, 5, 30]
    K.write_files(d, f"{tmp_path}/plain", "prompt", hashed=False)
    assert sorted(os.listdir(f"{tmp_path}/plain")) == [".json", "Cats___dogs.json", "ü.json"]


def test_a_repeated_task_leaves_one_file(tmp_path):
    from pyspark.sql import Row

    w = K._KeyedWriter(f"{tmp_path}/out", "job")
    task = [Row(file="a", value="1"), Row(file="a", value="2"), Row(file="b", value="3")]
    w.write(iter(task))  # its executor was lost before it was counted
    second, empty = w.write(iter(task)), w.write(iter([]))
    w.commit([second, empty, None])
    assert sorted(os.listdir(f"{tmp_path}/out")) == ["a.json", "b.json"] and open(f"{tmp_path}/out/a.json").read() == "1\n2\n"
    broken = K._KeyedWriter(f"{tmp_path}/out", "next")
    broken.abort([broken.write(iter(task[:1]))])
    assert sorted(os.listdir(f"{tmp_path}/out")) == ["a.json", "b.json"]


def test_appends_are_taken_up_again(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/sink"
    of = lambda *ids: spark.createDataFrame([(i, f"t{i}") for i in ids], "id long, text string")
    read = lambda: sorted((r.id is None, r.id or 0, r.text) for r in K.read_appended(spark, path, "id long, text string").collect())
    assert read() == [] and K.append_new(of(1, 2), path, "id") == 2
    assert K.append_new(of(2, 3, None), path, "id") == 2 and K.append_new(of(1, 3), path, "id") == 0
    assert [x[1] for x in read()] == [1, 2, 3, 0]
    # a run that breaks off between its rows and its rename
    from pyspark.sql.readwriter import DataFrameWriter

    with monkeypatch.context() as m:
        m.setattr(DataFrameWriter, "parquet", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            K.append_new(of(4, 5), path, "id")
    assert [x[1] for x in read()] == [1, 2, 3, 0]
    assert K.append_new(of(4, 5), path, "id") == 2 and len(read()) == 6
    # earlier rows aren't read: spoil them, and the keys still decide
    for d, _, files in os.walk(f"{tmp_path}/sink/batches"):
        for f in files:
            if d.endswith("rows") and f.endswith(".json"):
                open(f"{d}/{f}", "w").write("spoilt\n")
                if os.path.exists(f"{d}/.{f}.crc"):
                    os.remove(f"{d}/.{f}.crc")
    assert K.append_new(of(1, 6), path, "id") == 1
