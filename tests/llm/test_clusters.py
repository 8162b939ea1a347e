import numpy as np
import pytest

from tesela.llm import clusters

SCHEMA = "uc_id string, embedding array<float>, cluster_id int, grupo string, n int"


@pytest.fixture(scope="module")
def planted():
    r = np.random.default_rng(2)
    centres = np.eye(8)[:3] * 1.0
    rows, truth = [], {}
    for i in range(300):
        k = 0 if i < 150 else 1 + i % 2
        v = centres[k] + r.normal(0, 0.12, 8)
        label = [7, 3, 5][k]
        truth[f"u{i}"] = label
        shown = None if i % 17 == 0 else -1 if i % 19 == 0 else [7, 3, 5][(k + 1) % 3] if i % 11 == 0 else label
        rows.append((f"u{i}", [float(x * (1 + i % 3)) for x in v], shown, "x", 1))
    rows += [("nulo", None, 7, "x", 1), ("cero", [0.0] * 8, 7, "x", 1), ("corto", [1.0], 3, "x", 1), ("nan", [float("nan")] * 8, 3, "x", 1), ("vacio", [], None, "x", 1), ("lejos", [0.0] * 5 + [1.0, 0.0, 0.0], 3, "x", 1)]
    return rows, truth


def test_groups_names_and_members(spark, planted):
    rows, truth = planted
    frame = spark.createDataFrame(rows, SCHEMA)
    got = {r["uc_id"]: r for r in clusters.cluster(frame).collect()}
    assert len(got) == len(rows)
    assert all(got[k]["nombre"] == v for k, v in truth.items())
    for odd in ("nulo", "cero", "corto", "nan", "vacio", "lejos"):
        assert got[odd]["grupo"] is None and got[odd]["nombre"] is None


def test_description(spark, planted):
    rows, truth = planted
    groups = {r["nombre"]: r for r in clusters.describe(clusters.cluster(spark.createDataFrame(rows, SCHEMA)), top=3).collect()}
    assert {k: v["unidades"] for k, v in groups.items()} == {7: 150, 3: 75, 5: 75}
    assert all(len(g["tipicas"]) == 3 and {truth[u] for u in g["tipicas"]} == {k} for k, g in groups.items())


def test_typical_members_are_of_the_densest_cells(spark, planted):
    clustered = clusters.cluster(spark.createDataFrame(planted[0], SCHEMA)).checkpoint()
    density = {r["uc_id"]: (r["grupo"], r["densidad"]) for r in clustered.collect()}
    for g in clusters.describe(clustered, top=3).collect():
        most = max(n for k, n in density.values() if k == g["grupo"])
        assert most >= clusters.DENSE_LEAST and density[g["tipicas"][0]] == (g["grupo"], most)


def test_nothing_to_group(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert clusters.cluster(empty).count() == 0
    nameless = spark.createDataFrame([("a", [1.0, 0.0], None, "x", 1), ("b", None, -1, "x", 1)], SCHEMA)
    assert {r["nombre"] for r in clusters.cluster(nameless).collect()} == {None}
    alone = spark.createDataFrame([("a", [1.0, 0.0], 4, "x", 1)] * 1, SCHEMA)
    assert clusters.cluster(alone).count() == 1


def test_ties_of_names_go_to_the_smaller(spark):
    rows = [(f"a{i}", [1.0, 0.01 * i, 0.0], 1 + i % 2, "x", 1) for i in range(20)] + [(f"b{i}", [0.0, 0.01 * i, 1.0], 2, "x", 1) for i in range(20)]
    got = {r["uc_id"]: r["nombre"] for r in clusters.cluster(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {got[f"a{i}"] for i in range(20)} == {1} and {got[f"b{i}"] for i in range(20)} == {2}
