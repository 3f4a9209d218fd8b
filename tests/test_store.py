import pytest
from pyspark.sql import functions as F

from lectern.sources import chunk_store, files


def chunks(spark, rows):
    return spark.createDataFrame(rows, "book_id string, chunk_id string, text string")


def faults(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "book_id string")


def state(spark, path, version=None):
    return {r.book_id: (r.status, r.chunk_count) for r in chunk_store.books(spark, path, version).collect()}


def texts(spark, path, version=None):
    return sorted((r.book_id, r.text) for r in chunk_store.chunks(spark, path, version).collect())


def test_publications_replace_whole_books(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    assert state(spark, path) == {} and chunk_store.versions(spark, path) == []
    assert chunk_store.publish(chunks(spark, [("a", "1", "x"), ("a", "2", "y"), ("b", "1", "z")]), faults(spark, "c"), path) == 1
    assert state(spark, path) == {"a": ("ready", 2), "b": ("ready", 1), "c": ("failed", 0)}
    assert chunk_store.publish(chunks(spark, [("a", "1", "new"), ("c", "1", "c")]), faults(spark, "b"), path) == 2
    assert state(spark, path) == {"a": ("ready", 1), "b": ("failed", 1), "c": ("ready", 1)}
    assert texts(spark, path) == [("a", "new"), ("c", "c")]
    # the version before can still be read
    assert state(spark, path, 1)["a"] == ("ready", 2) and texts(spark, path, 1) == [("a", "x"), ("a", "y"), ("b", "z")]
    # the same again: another version, the same state
    assert chunk_store.publish(chunks(spark, [("a", "1", "new"), ("c", "1", "c")]), faults(spark, "b"), path) == 3
    assert state(spark, path) == state(spark, path, 2) and texts(spark, path) == texts(spark, path, 2)
    chunk_store.sweep(spark, path, keep=1)
    assert chunk_store.versions(spark, path) == [3] and texts(spark, path) == [("a", "new"), ("c", "c")]
    assert state(spark, path)["b"] == ("failed", 1)


@pytest.mark.parametrize("step", ["states", "log"])
def test_a_broken_publication_leaves_the_old_version(spark, tmp_path, monkeypatch, step):
    """The job ends after its chunks, or after chunks and state, were written."""
    path = f"file://{tmp_path}/store"
    chunk_store.publish(chunks(spark, [("a", "1", "old")]), faults(spark), path)
    with monkeypatch.context() as m:
        def stop(*_):
            raise KeyboardInterrupt

        if step == "log":
            m.setattr(chunk_store.Folder, "put_once", stop)
        else:
            m.setattr(chunk_store, "versions", stop)
        with pytest.raises(KeyboardInterrupt):
            chunk_store.publish(chunks(spark, [("a", "1", "new"), ("a", "2", "more")]), faults(spark), path)
    assert chunk_store.versions(spark, path) == [1] and state(spark, path) == {"a": ("ready", 1)} and texts(spark, path) == [("a", "old")]
    assert chunk_store.publish(chunks(spark, [("a", "1", "new"), ("a", "2", "more")]), faults(spark), path) == 2
    chunk_store.sweep(spark, path)
    assert texts(spark, path) == [("a", "more"), ("a", "new")] and texts(spark, path, 1) == [("a", "old")]


def test_two_publications_at_once_keep_both(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/store"
    put = chunk_store.Folder.put_once

    def late(self, name, text):
        monkeypatch.setattr(chunk_store.Folder, "put_once", put)
        chunk_store.publish(chunks(spark, [("b", "1", "first")]), faults(spark), path)
        return put(self, name, text)

    monkeypatch.setattr(chunk_store.Folder, "put_once", late)
    assert chunk_store.publish(chunks(spark, [("a", "1", "second")]), faults(spark), path) == 2
    assert texts(spark, path) == [("a", "second"), ("b", "first")]


def test_nothing_to_publish(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    assert chunk_store.publish(chunks(spark, []), faults(spark, "a", "a"), path) == 1
    assert state(spark, path) == {"a": ("failed", 0)} and texts(spark, path) == []


def test_run_logs_there_and_back(spark, tmp_path):
    path = str(tmp_path / "logs")
    manifests = spark.createDataFrame([("r1", {"p": "v1"}, "é"), ("r2", {"p": "v2"}, None)], "run_id string, prompt_versions map<string,string>, note string")
    records = spark.createDataFrame([("r1", k, f"id{k}", None if k % 2 else "answered", f"আমি \"{k}\"\nনা") for k in range(30)], "run_id string, ordinal int, id string, status string, answer string").repartition(4)
    files.write_run_logs(manifests, records, path)
    lines = spark.read.text(path + "/run_id=r1").collect()
    assert len(lines) == 31 and "prompt_versions" in lines[0].value and '"status":null' in lines[2].value and "আমি" in lines[1].value
    with open(path + "/run_id=r2/more.txt", "w") as f:
        f.write('{"id": "x", \n\n   \nplain\n[1, 2]\n{"id": "late", "ordinal": "no number"}\n')
    logs = files.read_run_logs(spark, path, "prompt_versions map<string,string>, note string", "ordinal int, id string, status string, answer string")
    assert sorted((r.run_id, r.note) for r in logs.manifests.collect()) == [("r1", "é"), ("r2", None)]
    key = ["run_id", "ordinal", "id", "status", "answer"]
    assert sorted(map(tuple, logs.records.select(key).collect()), key=repr) == sorted(map(tuple, records.select(key).collect()), key=repr)
    assert sorted(r.value for r in logs.bad.collect()) == sorted(['{"id": "x", ', "plain", "[1, 2]", '{"id": "late", "ordinal": "no number"}'])
    assert logs.bad.select(F.col("run_id")).distinct().first().run_id == "r2"
