import os

import duckdb
import pytest

from tesela.llm import queries

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")

COLUMNS = {
    "p1_found": ["tabla", "clave"], "p2_found": ["campo", "termino", "marca"], "p3_found": ["uc_id", "termino"], "p4_found": ["lemma_a", "lemma_b"],
    "p5_found": ["tabla", "clave", "tipo", "inicio"], "p6_found": ["tabla", "clave", "inicio"], "p7_found": ["uc_id", "cluster_id"], "p8_ids": ["doc_id", "ids"],
    "p10_found": ["doc_id_a", "doc_id_b"],
}


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query_runs_and_agrees_with_its_sql(spark, name):
    got = queries.queries()[name](spark, FOLDER)
    if name in COLUMNS:
        assert got.columns == COLUMNS[name]
    rows = got.collect()
    sql = queries.oracle_sql().get(name)
    if sql is None:
        assert rows or name in ("p10_found",)
        return
    db = duckdb.connect()
    for f in os.listdir(FOLDER):
        db.sql(f"create view {f[:-8]} as select * from '{FOLDER}/{f}'")
    want = db.sql(f"select {', '.join(got.columns)} from ({sql})").fetchall()
    assert sorted(map(repr, map(tuple, rows))) == sorted(map(repr, want))
