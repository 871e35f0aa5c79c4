"""The pN_ queries over the smallest tables: their SQL where they have one, else their columns and that they have rows."""

import glob
import os

import pytest

from oakloom.llm import queries, storage

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")
FOUND = {
    "p1_found": ["line_id_a", "line_id_b"], "p2_found": ["first_id", "sample_id"], "p3_found": ["sample_id_a", "sample_id_b"], "p4_found": ["sample_id"],
    "p5_found": ["sample_id", "defect"], "p7_found": ["doc_id", "item_id"], "p8_found": ["doc_id", "form"],
}


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_queries(spark, name):
    found = queries.queries()[name](spark, FOLDER)
    assert found.columns == FOUND.get(name, found.columns)
    rows = found.collect()
    assert rows
    if name in queries.oracle_sql():
        duckdb = pytest.importorskip("duckdb")
        con = duckdb.connect()
        for path in glob.glob(f"{FOLDER}/*.parquet"):
            con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
        expected = con.execute(queries.oracle_sql()[name])
        columns = [c[0] for c in expected.description]
        assert sorted(tuple(r[c] for c in columns) for r in rows) == sorted(expected.fetchall())


def test_pairs_are_those_of_groups(spark):
    """p3_found lies within p3_groups, and p3_representatives names every group with several variants."""
    group = {r.sample_id: r.group_id for r in queries.p3_groups(spark, FOLDER).collect()}
    pairs = queries.p3_found(spark, FOLDER).collect()
    assert all(group[r.sample_id_a] == group[r.sample_id_b] for r in pairs)
    assert {group[r.sample_id_a] for r in pairs} == {r.group_id for r in queries.p3_representatives(spark, FOLDER).collect()}


def test_no_machine_local_folder_on_a_cluster(spark):
    class Context:
        master = "spark://host:7077"

    class Conf:
        @staticmethod
        def get(name, default):
            return default

    class Session:
        sparkContext, conf = Context, Conf

    with pytest.raises(RuntimeError):
        storage.shared_folder(Session)


def test_dropped_tables_are_gone(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(storage, "shared_folder", lambda _: f"file://{tmp_path}")
    one = storage.written(spark.range(3), "x")
    assert one.count() == 3 and len(list(tmp_path.iterdir())) == 1
    storage.dropped(one)
    assert not list(tmp_path.iterdir())
