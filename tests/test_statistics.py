import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesela.functions import distributions as dist
from tesela.operators import classify, factor, lexical, metadata, network, space, terms


def test_yates_of_the_fixture(spark):
    inc = [(f"u{i}", "t") for i in range(15)]
    classes = [(f"u{i}", 1 if i < 10 else 2) for i in range(15)] + [(f"v{i}", 1 if i < 5 else 2) for i in range(25)] + [("ruido", -1), ("nulo", None)]
    got = terms.characteristic_terms(spark.createDataFrame(inc, "u string, termino string"), spark.createDataFrame(classes, "u string, k int"), "u", "k").orderBy("k").collect()
    assert got[0]["chi2_yates"] == 6.8338 and got[0]["phi"] == 0.4133 and got[1]["phi"] == -0.4133 and got[0]["significativo"]


def test_single_class_has_no_terms(spark):
    inc = spark.createDataFrame([("a", "t")], "u string, termino string")
    assert terms.characteristic_terms(inc, spark.createDataFrame([("a", 1)], "u string, k int"), "u", "k").count() == 0
    assert terms.characteristic_terms(inc.limit(0), spark.createDataFrame([], "u string, k int"), "u", "k").count() == 0


def test_benjamini_hochberg_of_the_fixture(spark):
    frame = spark.createDataFrame([(1, p) for p in (0.01, 0.04, 0.03, 0.20)], "k int, p double")
    got = {r["p"]: round(r["p_adj"], 4) for r in terms.benjamini_hochberg(frame, "p", "k").collect()}
    assert got == {0.01: 0.04, 0.03: 0.0533, 0.04: 0.0533, 0.20: 0.20}


def test_tails():
    assert dist.chi2_tail(3.841458820694124, 1) == pytest.approx(0.05) and dist.chi2_tail(7.814728, 3) == pytest.approx(0.05, abs=1e-6)
    even = sum(math.exp(-40 + i * math.log(40) - math.lgamma(i + 1)) for i in range(20))  # closed form for an even number
    assert dist.chi2_tail(80, 40) == pytest.approx(even, rel=1e-9) and dist.f_tail(4.0, 3, 20) == pytest.approx(0.02208, abs=1e-4)
    assert dist.f_tail(161.4476, 1, 1) == pytest.approx(0.05, abs=1e-5) and dist.fisher_greater(3, 1, 1, 3) == pytest.approx(17 / 70)


def test_cut_of_the_fixture():
    right, r2 = classify.best_cut(np.array([-1, -0.9, 1, 1.1]))
    assert list(right) == [False, False, True, True] and r2 == pytest.approx(0.9975, abs=1e-4)


def test_window_counts_of_the_fixture(spark):
    frame = spark.createDataFrame([("u", 0, "a"), ("u", 1, "b"), ("u", 2, "a")], "u string, i int, termino string")
    got = {(r["a"], r["b"]): r["conteo"] for r in network.window_counts(frame, "u").collect()}
    assert got == {("a", "b"): 4, ("a", "a"): 2}
    assert {r["conteo"] for r in network.window_counts(frame, "u", symmetric=False).collect()} == {2, 1}


def test_membership_of_the_fixture(spark):
    units = spark.createDataFrame([("u", [1.0, 0.0])], "u string, v array<double>")
    centroids = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "k int, centroide array<double>")
    got = {r["clase"]: r["pertenencia"] for r in space.soft_membership(units, centroids, "u", "k", "v", 2).collect()}
    assert got[1] == pytest.approx(0.9999546) and sum(got.values()) == pytest.approx(1)


@pytest.mark.parametrize("a,b,ari", [([0, 0, 1, 1], [5, 5, 7, 7], 1.0), ([0, 0, 1, 1], [0, 1, 0, 1], -0.5), ([0, 0], [1, 1], 1.0)])
def test_adjusted_rand_of_the_fixture(spark, a, b, ari):
    frame = lambda x: spark.createDataFrame(list(enumerate(x)), "u int, k int")
    assert classify.adjusted_rand(classify.overlap(frame(a), frame(b), "u", "k", "k")).collect()[0]["ari"] == pytest.approx(ari)


def test_hungarian_against_all_permutations():
    from itertools import permutations

    r = np.random.default_rng(0)
    for n, m in ((3, 3), (4, 4), (3, 5), (5, 3)):
        gain = r.integers(0, 20, (n, m)).astype(float)
        got = sum(gain[i, j] for i, j in classify.hungarian(gain))
        big, small = (gain, gain.T)[n > m], (gain, gain.T)[n > m]
        best = max(sum(small[i, p[i]] for i in range(small.shape[0])) for p in permutations(range(big.shape[1]), small.shape[0]))
        assert got == best


@pytest.fixture(scope="module")
def blocks(spark):
    """Two vocabularies, two kinds of units."""
    r = np.random.default_rng(3)
    rows = [(f"u{i:03d}", f"{'ab'[i % 2]}{j}") for i in range(120) for j in range(20) if r.random() < 0.4] + [(f"u{i:03d}", "comun") for i in range(120)]
    return spark.createDataFrame(rows, "u string, termino string")


def test_cdh_finds_the_blocks(blocks):
    assigned, tree = classify.cdh(blocks, "u")
    kinds = {}
    for r in assigned.collect():
        kinds.setdefault(r["clase"], set()).add(int(r["u"][1:]) % 2)
    assert len(kinds) >= 2 and all(len(k) == 1 for k in kinds.values()) and tree[0][3] == 120
    again, _ = classify.cdh(blocks.repartition(3), "u")
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, assigned.collect()))


def test_cdh_by_joins_finds_the_same_blocks(blocks):
    assigned, tree = classify.cdh(blocks, "u", node_cells=400)
    kinds = {}
    for r in assigned.collect():
        kinds.setdefault(r["clase"], set()).add(int(r["u"][1:]) % 2)
    assert len(kinds) >= 2 and all(len(k) == 1 for k in kinds.values()) and sum(t[3] for t in tree if t[4]) == 120


def test_swap_and_density():
    rows = np.repeat(np.arange(8), 2)
    cols = np.array([0, 1] * 4 + [2, 3] * 4)
    start = np.array([False, False, False, True, True, True, True, True])
    assert list(classify.swap(rows, cols, 8, 4, start)) == [False] * 4 + [True] * 4
    vectors = np.repeat(np.eye(2), 4, axis=0)
    assert list(classify.swap(rows, cols, 8, 4, start, vectors=vectors)) == [False] * 4 + [True] * 4
    points = np.concatenate([np.random.default_rng(1).normal(c, 0.1, (20, 2)) for c in (0, 5)])
    labels = classify.density_labels(points)
    assert len(set(labels[:20])) == len(set(labels[20:])) == 1 and labels[0] != labels[-1]


def test_verdicts(spark):
    a = spark.createDataFrame([("u", 1, True), ("v", 2, False)], "u string, k int, estable boolean")
    b = spark.createDataFrame([("u", 1, False)], "u string, k int, estable boolean")
    got = {m: {r["u"]: (r["estable"], r["etiqueta"]) for r in classify.verdicts({"wc": a, "emb": b}, "u", "k", m).collect()} for m in ("any", "all", "primary")}
    assert got["any"]["u"] == (True, "wc") and got["all"]["u"][0] is False and got["primary"]["v"] == (False, "inestable")


def test_correspondence_of_a_table(spark):
    table = {("x", "a"): 10, ("x", "b"): 2, ("y", "a"): 3, ("y", "b"): 9, ("z", "a"): 5, ("z", "c"): 6}
    counts = spark.createDataFrame([(k, t, n) for (k, t), n in table.items()], "k string, termino string, unidades int")
    rows, columns, inertia = factor.correspondence(counts, "k", pseudo=0.01)
    m = np.array([[table.get((k, t), 0) + 0.01 for t in "abc"] for k in "xyz"])
    p = m / m.sum()
    r, c = p.sum(axis=1), p.sum(axis=0)
    s = np.linalg.svd((p - np.outer(r, c)) / np.sqrt(np.outer(r, c)), compute_uv=False)
    assert np.allclose(inertia, (s**2)[:2]) and rows.count() == columns.count() == 6
    assert sum(x["contribucion"] for x in columns.where("eje = 0").collect()) == pytest.approx(1)
    assert len(factor.dendrogram(columns)) == 2


def test_ward_heights():
    merges = network.ward(np.array([[0.0], [1.0], [10.0]]))
    assert [tuple(m[:2]) for m in merges] == [(0, 1), (2, 3)] and merges[0][2] == pytest.approx(1) and merges[1][2] == pytest.approx(math.sqrt(2 * 2 * 1 / 3) * 9.5)


def test_graph_kernels(spark):
    rows = [(a, b, 1.0) for g in ("abcd", "wxyz") for i, a in enumerate(g) for b in g[i + 1 :]] + [("d", "w", 0.1)]
    edges = spark.createDataFrame(rows, "a string, b string, peso double")
    nodes = {r["nodo"]: r for r in network.communities(edges, "peso").collect()}
    assert len({nodes[v]["comunidad"] for v in "abcd"}) == len({nodes[v]["comunidad"] for v in "wxyz"}) == 1 and nodes["a"]["comunidad"] != nodes["z"]["comunidad"]
    assert nodes["d"]["intermediacion"] > nodes["a"]["intermediacion"] == 0
    rank = {r["nodo"]: r["pr"] for r in network.pagerank(edges, "peso").collect()}
    assert sum(rank.values()) == pytest.approx(1) and rank["d"] > rank["a"]
    assert network.label_communities(edges.where("peso = 1")).select("grupo").distinct().count() == 2
    whole = network.communities(edges, "peso")
    assert "<edge" in network.gexf(whole, edges, "peso") and network.bridges(whole, edges).count() == 2
    summary = network.community_summary(whole, edges, "peso", spark.createDataFrame([(v, 1) for v in "abcdwxyz"], "termino string, unidades long")).collect()
    assert [(r["n"], r["puentes"], r["densidad"]) for r in summary] == [(4, 1, 1.0)] * 2


def test_network_holds_pairs_of_two_units(spark, tmp_path):
    from tesela.plans import registry

    rows = [(f"u{i}", 1, ["casa", "sol"] if i < 2 else [f"x{i % 3}"], 0) for i in range(30)]
    spark.createDataFrame(rows, "uce_id string, doc_id long, stems array<string>, cluster_id int").write.parquet(str(tmp_path / "uces.parquet"))
    run = lambda name: registry.queries()[name](spark, str(tmp_path)).collect()
    assert {r["nodo"] for r in run("network_pagerank")} == {r["nodo"] for r in run("network_communities")} == {"casa", "sol"}
    assert [r["n"] for r in run("community_summary")] == [2]


def test_networks_beyond_the_kernels(spark, monkeypatch):
    r = np.random.default_rng(3)
    pairs = [(i, j) for i in range(240) for j in range(i) if r.random() < (0.25 if i % 4 == j % 4 else 0.01)]
    edges = spark.createDataFrame([(f"n{i:03}", f"n{j:03}", 1.0 + (i * j) % 3) for i, j in pairs], "a string, b string, peso double")
    held = {x["nodo"]: x for x in network.communities_of_any_size(edges, "peso").collect()}
    alone = network.betweenness(network._collected(edges, "peso"))
    assert all(held[v]["intermediacion"] == pytest.approx(alone[v]) for v in alone) and len(alone) == 240
    monkeypatch.setattr(network, "KERNEL_EDGES", 500)
    got = {x["nodo"]: x for x in network.communities_of_any_size(edges, "peso").collect()}
    assert set(got) == set(held) and all(x["intermediacion"] is None for x in got.values())
    for k in range(4):  # the planted groups
        assert len({got[f"n{i:03}"]["comunidad"] for i in range(k, 240, 4)}) == 1
    assert len({x["comunidad"] for x in got.values()}) == 4


def test_metadata_tests(spark):
    rows = [(i, "ab"[i % 2], "xy"[(i % 2) ^ (i % 7 == 0)], float(i % 2) + (i % 5) / 10, None) for i in range(70)]
    frame = spark.createDataFrame(rows, "u int, k string, v string, n double, z string")
    got = metadata.chi2_test(frame, "k", "v").collect()[0]
    assert got["gl"] == 1 and got["p"] < 1e-6 and metadata.chi2_test(frame, "k", "z").count() == 0
    f = metadata.anova(frame, "k", "n").collect()[0]
    assert f["p"] < 1e-10 and 0 < f["eta2"] < 1
    p = metadata.permutation_test(frame, "u", "k", "v", 30).collect()[0]
    assert p["p"] == pytest.approx(1 / 31) and p["chi2"] == pytest.approx(got["chi2"])
    assert metadata.without_outliers(frame.union(frame.limit(1).withColumn("n", F.lit(99.0))), "n").count() == 70


def test_shapley_adds_up():
    worth = lambda s: len(s) + (2 if {"a", "b"} <= set(s) else 0)
    from itertools import combinations

    players = ["a", "b", "c"]
    values = {frozenset(s): worth(s) for k in range(4) for s in combinations(players, k)}
    got = metadata.shapley(values, players)
    assert got == {"a": 2.0, "b": 2.0, "c": 1.0}


def test_mtld_and_diversity(spark):
    frame = spark.createDataFrame([("x", ["a"] * 10), ("y", [f"w{i}" for i in range(10)]), ("z", [])], "u string, t array<string>")
    got = {r["u"]: r["m"] for r in frame.select("u", lexical.mtld(F.col("t")).alias("m")).collect()}
    assert got["x"] == pytest.approx(2.0) and got["y"] == 10.0 and got["z"] == 0.0
    v = spark.createDataFrame([("u", [1.0, 0.0]), ("u", [0.0, 2.0]), ("u", [1.0, 0.0])], "u string, v array<double>")
    assert lexical.semantic_diversity(v, "u", "v").collect()[0]["diversidad"] == pytest.approx(2 / 3)


def test_retrofit_draws_neighbours_together(spark):
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [1.0, 1.0])], "word string, vec array<double>")
    edges = spark.createDataFrame([("a", "b", 1.0)], "a string, b string, peso double")
    got = {r["word"]: r["vec"] for r in space.retrofit(vectors, edges, 2, rounds=20).collect()}
    assert np.allclose(got["a"], [2 / 3, 1 / 3], atol=1e-4) and got["c"] == [1.0, 1.0]


def test_lexicon_lookup_and_bands(spark):
    terms_ = spark.createDataFrame([("u", 0, "casa"), ("u", 1, "raro"), ("u", 2, "casa")], "u string, i int, termino string")
    lexicon = spark.createDataFrame([("casa", 100.0, 5.5, 0.8, 50.0)], "word string, subtlwf double, zipf double, cd double, freqcount double")
    scored = lexical.with_lexicon(terms_, lexicon)
    got = {r["banda"]: r for r in lexical.band_profile(scored).collect()}
    assert got["B2"]["n_tokens"] == 2 and got["B5"]["n_tokens"] == got["B_oov"]["n_tokens"] == 1
    one = lexical.sophistication(scored, "u").collect()[0]
    assert one["pct_oov"] == pytest.approx(1 / 3) and one["oral"] == pytest.approx(2 / 3)
    assert lexical.rarest(scored, "u", 1).collect()[0]["termino"] == "raro"


def test_every_cut_of_a_large_axis_is_tried(spark):
    """The cut of an axis sorted over many tasks is that of the axis whole, also with ties."""
    from tesela.operators import classify

    r = np.random.default_rng(4)
    for x in (np.concatenate([r.normal(0, 1, 150), r.normal(4, 1, 90)]), np.repeat([1.0, 2.0, 7.0], 20), r.random(37)):
        frame = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "u int, x double").repartition(5)
        right, r2 = classify.best_cut(x)
        border, share = classify.best_cut_of(frame, "u")
        assert abs(share - r2) < 1e-9 and ((x >= border) == right).all()
    assert classify.best_cut_of(spark.createDataFrame([(1, 2.0), (2, 2.0)], "u int, x double"), "u") is None


def test_factor_has_the_count_in_its_margins_alone():
    from tesela.operators import classify

    r = np.random.default_rng(8)
    table = (r.random((20, 9)) < 0.5).astype(float)
    rows, cols = np.nonzero(table)
    x = classify.first_factor(rows, cols, table[rows, cols], 20, 9, 0.01, 2000)
    row, col = table.sum(axis=1) + 0.09, table.sum(axis=0) + 0.2
    y = table @ ((table.T @ x) / col) / row
    y -= (row / row.sum() * y).sum()
    y /= np.linalg.norm(y)
    assert min(np.abs(x - y).max(), np.abs(x + y).max()) < 1e-6 and abs(np.linalg.norm(x) - 1) < 1e-9
    vectors = r.standard_normal((20, 3)) * [5, 1, 1]
    assert abs(np.corrcoef(classify.warm_start(vectors), vectors[:, 0])[0, 1]) > 0.95 and classify.warm_start(vectors[:4]) is None
    warm = classify.first_factor(rows, cols, table[rows, cols], 20, 9, 0.01, 2000, classify.warm_start(vectors))
    assert np.abs(warm - x).max() < 1e-5


def test_parts_of_a_node_are_the_same_in_one_kernel_or_in_rounds(spark, blocks, monkeypatch):
    """Nodes of any size below the bound are cut by kernels, without the joins, and packed units stay one row each."""
    monkeypatch.setattr(classify, "large_cut", None)
    weighed = blocks.withColumn("w", F.lit(0.5))
    once, tree = classify.cdh(blocks, "u", inline_cells=10**9)
    for df, settings in ((blocks, {"inline_cells": 0}), (weighed, {"inline_cells": 300, "weight": "w", "pseudo": 0.005})):
        again, other = classify.cdh(df, "u", **settings)
        assert sorted(map(tuple, again.collect())) == sorted(map(tuple, once.collect())) and other == tree


def test_swaps_and_factor_by_chunks_are_those_of_the_plain_formulas(monkeypatch):
    monkeypatch.setattr(classify, "CHUNK", 7)
    r = np.random.default_rng(5)
    table = (r.random((30, 12)) < 0.35) | (r.integers(0, 12, 30)[:, None] == np.arange(12))
    rows, cols = np.nonzero(table)
    right = r.random(30) < 0.5

    def chi(side, t):
        n = np.array([(~side).sum(), side.sum()])
        c = np.array([table[~side].sum(axis=0), table[side].sum(axis=0)])[:, t]
        e = c.sum(axis=0) * n[:, None] / n.sum()
        return ((c - e) ** 2 / e).sum()

    want = right.copy()
    for _ in range(2):
        for i in range(30):
            other = want.copy()
            other[i] = not other[i]
            if other.any() and not other.all() and chi(other, table[i]) > chi(want, table[i]) + 1e-9:
                want = other
    assert list(classify.swap(rows, cols, 30, 12, right)) == list(want)
    some = r.permutation(len(rows))
    plain = classify.first_factor(rows, cols, np.ones(len(rows)), 30, 12)
    assert np.allclose(classify.first_factor(rows.astype(np.int32)[some], cols.astype(np.int32)[some], None, 30, 12), plain)


def test_hashes_of_rounds_are_those_of_spark(spark):
    units = spark.createDataFrame([(f"u{i}",) for i in range(50)], "u string")
    got = units.select(F.xxhash64("u").alias("h"), F.array(*(F.xxhash64("u", F.lit(r), F.lit(42)) for r in range(4))).alias("v")).collect()
    assert terms.round_hashes(np.array([x["h"] for x in got]), 4, 42).tolist() == [x["v"] for x in got]


def test_thresholds_are_those_of_labels_dealt_in_the_order_of_the_hashes(spark, monkeypatch):
    """The labels of each round by a plain sort, with blocks and bins of a few units."""
    monkeypatch.setattr(terms, "BLOCK", 7)
    r = np.random.default_rng(2)
    labels = {f"u{i:02d}": int(r.integers(0, 3)) for i in range(60)}
    cells = [(u, t) for u in labels for t in "abc" if r.random() < 0.5]
    inc, k = spark.createDataFrame(cells, "u string, termino string"), spark.createDataFrame(list(labels.items()) + [("ruido", -1), ("nulo", None)], "u string, k int")
    got = {(x["termino"], x["k"]): x["umbral"] for x in terms.permutation_thresholds(inc, k, "u", "k", rounds=9).collect()}
    h = {x["u"]: x["v"] for x in k.select("u", F.array(*(F.xxhash64("u", F.lit(j), F.lit(42)) for j in range(9))).alias("v")).collect()}
    dealt, size = sorted(labels.values()), {c: sum(v == c for v in labels.values()) for c in range(3)}
    new = [dict(zip(sorted(labels, key=lambda u: h[u][j]), dealt)) for j in range(9)]
    for t in "abc":
        own = [u for u, x in cells if x == t]
        for c in range(3):
            e = len(own) * size[c] / 60
            want = np.quantile([(sum(new[j][u] == c for u in own) - e) ** 2 / e for j in range(9)], 0.95)
            assert got[t, c] == pytest.approx(want)


def test_stability_makes_no_row_for_a_cell_and_a_round(spark, monkeypatch):
    """The draws are made in kernels: neither rounds are exploded nor are cells joined with them."""
    inc = spark.createDataFrame([(f"u{i}", t) for i in range(40) for t in ("a" if i < 20 else "b", "c")], "u string, termino string")
    k = spark.createDataFrame([(f"u{i}", int(i >= 20)) for i in range(40)], "u string, k int")

    def refused(*_):
        raise AssertionError("rounds are exploded")

    monkeypatch.setattr(F, "explode", refused)
    got = {(x["termino"], x["k"]): x["frecuencia_seleccion"] for x in terms.term_stability(inc, k, "u", "k", rounds=20).collect()}
    assert got == {("a", 0): 1.0, ("b", 1): 1.0, ("c", 0): 0.0, ("c", 1): 0.0}


def counted(df, count):
    """The same rows, each adding 1 to ``count`` whenever it is made."""

    def run(batches):
        for batch in batches:
            count.add(batch.num_rows)
            yield batch

    return df.mapInArrow(run, df.schema)


def test_stability_reads_its_units_once(spark, blocks, monkeypatch):
    """Both classifications come from one written table, and are those of the incidence of each."""
    from tesela.plans import space_plans

    rare = [("u000", "raro"), ("u001", "raro"), ("u002", "raro"), ("u003", "unico"), ("u004", " "), ("u005", None)]
    cells = blocks.union(spark.createDataFrame(rare, "u string, termino string"))
    frame = cells.select(F.concat_ws("_", "u", "termino").alias("uce_id"), F.col("u").alias("uc_id"), F.array(F.upper("termino")).alias("stems"))
    count = spark.sparkContext.accumulator(0)
    monkeypatch.setattr(space_plans, "units", lambda *_: counted(frame, count))
    got = {(r["clase"], r["estable"]): r["n"] for r in space_plans.cdh_stability(spark, "").collect()}
    assert count.value == frame.count()
    clean = cells.where("trim(termino) <> ''")
    sized = clean.groupBy("termino").count()
    parts = [classify.cdh(clean.join(sized.where(F.col("count") >= least), "termino", "left_semi"), "u")[0] for least in (3, 5)]
    want = classify.stable_units(*parts, "u", "clase", "clase").groupBy("clase", "estable").count().collect()
    assert got == {(r["clase"], r["estable"]): r["count"] for r in want} and len(got) >= 2


@pytest.mark.parametrize("most, least", [(4096, 64), (16, 4), (3, 1)])
def test_swaps_at_once_are_those_made_one_by_one(most, least):
    r = np.random.default_rng(11)
    for n, m, share in ((90, 12, 0.3), (60, 4, 0.6), (40, 30, 0.05)):
        table = r.random((n, m)) < share
        rows, cols = np.nonzero(table)
        right = r.random(n) < 0.5
        total, want = np.maximum(table.sum(axis=0), 1), right.copy()

        def chi(side, t):
            p = side.sum() / n
            c = table[side].sum(axis=0)[t]
            return float(((c - p * total[t]) ** 2 / total[t]).sum() / (p * (1 - p))) if 0 < p < 1 else 0.0

        for _ in range(2):
            for i in range(n):
                if table[i].any() and (want == want[i]).sum() > 1:
                    other = want.copy()
                    other[i] = not other[i]
                    old = chi(want, table[i])
                    if chi(other, table[i]) - old > 1e-9 * (1 + old):
                        want = other
        assert list(classify.swap_at_once(rows, cols, n, m, right, 2, most, least)) == list(want)


def test_factor_on_the_terms_is_that_on_the_cells(monkeypatch):
    """Converged or stopped by the number of rounds, with weights or without, also with units that have no cell."""
    r = np.random.default_rng(12)
    table = r.random((400, 10)) < 0.4
    table[[3, 50]] = False
    rows, cols = np.nonzero(table)
    monkeypatch.setattr(classify, "GRAM_PAIRS", 500)
    for weights in (None, r.random(len(rows))):
        for steps in (3, 100, 3000):
            monkeypatch.setattr(classify, "GRAM_TERMS", 4096)
            terms_ = classify.first_factor(rows, cols, weights, 400, 10, 0.01, steps)
            monkeypatch.setattr(classify, "GRAM_TERMS", 0)
            assert np.abs(terms_ - classify.first_factor(rows, cols, weights, 400, 10, 0.01, steps)).max() < 1e-7
