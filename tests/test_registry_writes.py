"""Writers of the registry and its sinks."""

import pytest
from pyspark.sql import functions as F

from oakloom.operators import registry, windows
from oakloom.sources import files, settings, sinks


def test_versions_follow_the_largest(spark):
    there = spark.createDataFrame([("a", "2"), ("a", "10"), ("b", "x"), (None, "4")], "name string, version string")
    new = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "c"), (5, None)], "id bigint, name string")
    got = {r.id: r.version for r in registry.registered(there, new, "id").collect()}
    assert got == {1: "11", 2: "12", 3: "1", 4: "1", 5: "5"}
    assert registry.registered(there, new.limit(0), "id").count() == 0


def test_stages_and_missing_versions(spark):
    there = spark.createDataFrame([("a", "1", "Staging"), ("a", "2", None)], "name string, version string, stage string")
    changes = spark.createDataFrame([("a", "1", "Production", 1), ("a", "1", None, 2), ("a", "9", "Archived", 3)], "name string, version string, stage string, seq bigint")
    after, missing = registry.staged(there, changes)
    assert {tuple(r) for r in after.collect()} == {("a", "1", None), ("a", "2", None)} and [r.version for r in missing.collect()] == ["9"]


def test_updates_take_the_time_and_tell_what_is_missing(spark):
    rows = spark.createDataFrame([(1, "created", 10), (2, "created", 10)], "id bigint, status string, updated_at bigint")
    changes = spark.createDataFrame([(1, "running", 20, 1), (1, "failed", 30, 2), (7, "failed", 30, 3)], "id bigint, status string, updated_at bigint, seq bigint")
    after, missing = registry.updated(rows, changes, "status")
    assert {tuple(r) for r in after.collect()} == {(1, "failed", 30), (2, "created", 10)} and [r.id for r in missing.collect()] == [7]


def test_metrics_are_patched_key_by_key(spark):
    rows = spark.createDataFrame([(1, '{"a": 1, "b": 2}'), (2, None), (3, '{"a": 5}')], "id bigint, metrics string")
    patches = spark.createDataFrame([(1, {"b": 3.0}, 1), (1, {"b": None, "c": 4.0}, 2), (2, {"x": 1.0}, 1)], "id bigint, patch map<string,double>, seq bigint")
    got = {r.id: r.metrics for r in registry.patched_metrics(rows, patches).collect()}
    assert got == {1: '{"a":1.0,"b":null,"c":4.0}', 2: '{"x":1.0}', 3: '{"a": 5}'}


def test_one_text_file_without_a_last_line_end(spark, tmp_path):
    rows = spark.createDataFrame([(k, f"line {k}") for k in range(40)], "at bigint, line string")
    sinks.write_text(rows, str(tmp_path / "parts"), ["at"])
    target = tmp_path / "all.txt"
    for _ in range(2):
        sinks.join_parts(spark, str(tmp_path / "parts"), str(target))
        assert target.read_text() == "\n".join(f"line {k}" for k in range(40))
    sinks.write_text(rows.limit(0), str(tmp_path / "none"), ["at"])
    sinks.join_parts(spark, str(tmp_path / "none"), str(target))
    assert target.read_text() == ""


class Failing:
    """A file system on which the n-th rename fails."""

    def __init__(self, files, n):
        self.files, self.left = files, n

    def __getattr__(self, name):
        return getattr(self.files, name)

    def rename(self, a, b):
        self.left -= 1
        return False if self.left == 0 else self.files.rename(a, b)


@pytest.mark.parametrize("n", [1, 2])
def test_a_failed_rename_keeps_the_table(spark, tmp_path, monkeypatch, n):
    path = str(tmp_path / "t")
    sinks.replace_table(spark.range(3), path)
    real = sinks._files
    monkeypatch.setattr(sinks, "_files", lambda s, p: (Failing(real(s, p)[0], n), real(s, p)[1]))
    with pytest.raises(OSError):
        sinks.replace_table(spark.range(5), path)
    assert spark.read.parquet(path).count() == 3


def test_run_header_and_artifacts(spark, tmp_path):
    store, file = str(tmp_path / "s"), tmp_path / "m.bin"
    file.write_bytes(b"weights")
    log = sinks.RunLog(spark, "r", [store])
    assert log.start({"lr": 1}, "first") == 1 and log.artifact(str(file), "models") == 1 and log.artifact(str(tmp_path / "missing")) == 0 and log.finish() == 1
    assert (tmp_path / "s/artifact_files/r/models/m.bin").read_bytes() == b"weights"
    assert {(r.status, r.name) for r in spark.read.parquet(store + "/runs").collect()} == {("running", "first"), ("finished", None)}
    assert spark.range(1).select((F.unix_timestamp(sinks.utc_now()) - F.unix_timestamp())).first()[0] in range(-2, 3)


def test_existing_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x")
    rows = spark.createDataFrame([(str(tmp_path / "a.txt"),), (str(tmp_path / "b.txt"),), (str(tmp_path / "no" / "c.txt"),), (None,)], "p string")
    assert [r.p for r in files.existing(rows, "p").collect()] == [str(tmp_path / "a.txt")]
    assert files.exists(spark, str(tmp_path)) and not files.exists(spark, str(tmp_path / "b.txt"))


def test_env_file_and_case(tmp_path, monkeypatch):
    (tmp_path / ".env").write_text("# note\nexport PORT=7\nhost='a b'\n\nDEBUG=true # why\nOTHER=1\n")
    monkeypatch.setenv("debug", "false")
    assert settings.settings({"port": 1, "host": "x", "debug": True}, str(tmp_path / ".env")) == {"port": 7, "host": "a b", "debug": False}
    assert settings.env_file(str(tmp_path / "none")) == {}


def test_items(spark):
    df = spark.createDataFrame([(k * 7, f"s{k}") for k in range(50)], "id bigint, s string").repartition(5)
    assert {(r.place, r.s, r.samples) for r in windows.items(df, "id", [0, 3, -1]).collect()} == {(0, "s0", 50), (3, "s3", 50), (49, "s49", 50)}
    with pytest.raises(IndexError):
        windows.items(df, "id", [50])


def test_repeated_keys_are_packed_whole(spark):
    rows = [(1, [1, 2, 3]), (1, [4, 5, 6]), (2, [7, 8, 9])]
    df = spark.createDataFrame(rows, "k bigint, t array<int>")
    got = [r.window for r in windows.pack_windows(df, "k", "t", 3, 1).orderBy("k").collect()]
    stream = got[0] + [w[-1] for w in got[1:]]
    assert all(len(w) == 4 for w in got) and stream in ([1, 2, 3, 4, 5, 6, 7, 8, 9], [4, 5, 6, 1, 2, 3, 7, 8, 9])
    texts = spark.createDataFrame([(1, "ab", 2), (1, "cd", 1), (0, "é🙂", 3), (2, None, 4)], "k bigint, t string, o int")
    assert [r.window for r in windows.pack_texts(texts, "k", "t", 2, 2, ties=("o",)).orderBy("k").collect()] == ["é🙂c", "cda"]
