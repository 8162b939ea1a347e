import math
from collections import Counter

import pytest

from tesela.llm import cooc, terms
from tesela.llm.common import term, units

SCHEMA = "uc_id string, lemmas array<string>, stems array<string>, bigrams array<string>, campo string, n int"
ROWS = [
    ("a", ["Casa", "casa ", " \t", None, "sol"], ["cas"], None, "x", 1),
    ("b", ["casa", "mar"], [], ["casa_mar"], "x", 1),
    ("c", None, None, None, "x", 1),
    ("d", ["café", "café", "ΧΡΈΟΣ"], ["x"] * 3, [None], "x", 1),
]


@pytest.fixture
def records(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def test_values_are_cleaned(spark):
    got = spark.createDataFrame([("  Ábaco\t",), ("Á",), (None,), (" ",)], "v string").select(term(__import__("pyspark").sql.functions.col("v")).alias("t")).collect()
    assert [r["t"] for r in got] == ["ábaco", "á", None, ""]


def test_frequencies_and_marks(records):
    counts = terms.record_terms(records, "uc_id", "lemmas", "stems", "bigrams")
    got = {(r["campo"], r["termino"]): (r["apariciones"], r["unidades"], r["marca"]) for r in terms.term_frequencies(counts, 4).collect()}
    assert got[("lemmas", "casa")] == (3, 2, "raro") and got[("lemmas", "café")] == (2, 1, "raro")
    assert got[("lemmas", "χρέος")][0] == 1 and ("lemmas", "") not in got and got[("stems", "x")] == (3, 1, "raro")
    common = terms.term_frequencies(counts, 4, rare_below=2, common_tenths=5)
    assert {r["termino"]: r["marca"] for r in common.collect() if r["campo"] == "lemmas"}["casa"] == "comun"


def test_empty_tables(records):
    counts = terms.record_terms(records.limit(0), "uc_id", "lemmas")
    assert terms.term_frequencies(counts, 0).count() == 0
    assert terms.divergence_scores(counts, "uc_id", 0).count() == 0


def test_repeated_rows_count_once(spark, tmp_path):
    spark.createDataFrame(ROWS + ROWS[:2], SCHEMA).write.parquet(str(tmp_path / "ucs.parquet"))
    assert units(spark, str(tmp_path), "lemmas").count() == 4


@pytest.mark.parametrize("repeated_keys", [200_000, 0])
def test_first_rows_of_repeated_keys(spark, tmp_path, monkeypatch, repeated_keys):
    """A key of a third of all rows, over several files, counts once; both ways give the same rows."""
    from tesela.llm import common

    monkeypatch.setattr(common, "REPEATED_KEYS", repeated_keys)
    rows = [(f"u{i}", ["x", f"y{i}"]) for i in range(40)] + [("u0", ["x", "y0"])] * 20 + [(None, ["x"])]
    spark.createDataFrame(rows, "uc_id string, lemmas array<string>").repartition(5).write.parquet(str(tmp_path / "ucs.parquet"))
    got = units(spark, str(tmp_path), "lemmas")
    assert sorted(map(tuple, got.collect())) == sorted((k, v) for k, v in rows[:40]) and got.columns == ["uc_id", "lemmas"]


@pytest.mark.parametrize("broadcast_terms", [500_000, 0])
def test_scores_against_the_formula(records, monkeypatch, broadcast_terms):
    monkeypatch.setattr(terms, "BROADCAST_TERMS", broadcast_terms)
    counts = terms.record_terms(records, "uc_id", "lemmas")
    got = {(r["uc_id"], r["termino"]): r["puntaje"] for r in terms.divergence_scores(counts, "uc_id", 4).collect()}
    tf = {k: Counter(v) for k, v in {"a": ["casa", "casa", "sol"], "b": ["casa", "mar"], "d": ["café", "café", "χρέος"]}.items()}
    total = Counter()
    for c in tf.values():
        total.update(c)
    mean = sum(total.values()) / 4
    for key, c in tf.items():
        for t, n in c.items():
            lam, tfn = total[t] / 4, n * math.log2(1 + mean / sum(c.values()))
            assert got[key, t] == pytest.approx((math.log2(1 + lam) + tfn * math.log2((1 + lam) / lam)) / (tfn + 1))


def test_rare_shared_terms_score_above_common_ones(spark):
    rows = [(f"u{i}", ["todo", "raro", "raro"] if i < 2 else ["todo", f"x{i % 5}"]) for i in range(40)]
    counts = terms.record_terms(spark.createDataFrame(rows, "uc_id string, lemmas array<string>"), "uc_id", "lemmas")
    got = {(r["uc_id"], r["termino"]): r["puntaje"] for r in terms.divergence_scores(counts, "uc_id", 40).collect()}
    assert got["u0", "raro"] > 2 * got["u0", "todo"]


def brute_pairs(sets, n, min_pairs, per, lift):
    f, pairs = Counter(), Counter()
    for s in sets:
        f.update(s)
        pairs.update((a, b) for a in s for b in s if a < b)
    return {(a, b): k for (a, b), k in pairs.items() if k >= min_pairs and per * k >= n and k * n >= lift * f[a] * f[b]}


def test_pairs_against_brute_force(spark):
    import random

    r = random.Random(5)
    sets = []
    for _ in range(400):
        s = {f"w{r.randrange(60)}" for _ in range(r.randrange(0, 6))}
        if r.random() < 0.03:
            s |= {"par_a", "par_b"}
        sets.append(s)
    frame = spark.createDataFrame([(sorted(s) or None, "x") for s in sets], "lemmas array<string>, item string")
    got = {(x["lemma_a"], x["lemma_b"]): x for x in cooc.pair_surprise(frame, "lemmas", "lemma", 400, 3, 2000, 4).collect()}
    want = brute_pairs(sets, 400, 3, 2000, 4)
    assert {k: v["n_ab"] for k, v in got.items()} == want and ("par_a", "par_b") in got
    planted = got["par_a", "par_b"]
    assert planted["veces"] > 5 and planted["q"] < 1e-6 and all(0 < v["p"] <= 1 and v["q"] >= v["p"] for v in got.values())


@pytest.mark.parametrize("broadcast_items,wide", [(200_000, 1024), (0, 1024), (200_000, 2), (0, 3)])
def test_all_pairs_of_items_of_any_frequency(spark, monkeypatch, broadcast_items, wide):
    import random

    monkeypatch.setattr(cooc, "BROADCAST_ITEMS", broadcast_items)
    monkeypatch.setattr(cooc, "WIDE", wide)
    r = random.Random(6)
    sets = [{"todo"} | {f"w{r.randrange(40)}" for _ in range(r.randrange(0, 5))} | ({"par_a", "par_b"} if r.random() < 0.1 else set()) for _ in range(300)]
    frame = spark.createDataFrame([(sorted(s),) for s in sets], "lemmas array<string>")
    got = {(x["lemma_a"], x["lemma_b"]): x for x in cooc.pair_surprise(frame, "lemmas", "lemma", 300).collect()}
    assert {k: v["n_ab"] for k, v in got.items()} == brute_pairs(sets, 300, 1, 300, 0) and ("par_a", "todo") in got
    f = Counter(x for s in sets for x in s)
    assert all((v["n_a"], v["n_b"]) == (f[a], f[b]) for (a, b), v in got.items())
    ranked, tests, q = sorted((v["p"], k) for k, v in got.items()), len(f) * (len(f) - 1) / 2, 1.0
    for i in range(len(ranked), 0, -1):  # Benjamini-Hochberg over all pairs, those of no record with p = 1
        p, k = ranked[i - 1]
        q = min(q, p * tests / i)
        assert q * 0.999 <= got[k]["q"] <= min(1, q * 10**cooc.P_STEP * 1.001)
    assert got["par_a", "par_b"]["q"] < 1e-6


def test_query_keeps_pairs_below_the_bounds_of_found(spark, tmp_path):
    from tesela.llm import queries

    rows = [(f"u{i}", ["todo", "a", "b"] if i < 2 else ["todo", f"x{i % 5}"]) for i in range(40)]
    spark.createDataFrame(rows, "uc_id string, lemmas array<string>").write.parquet(str(tmp_path / "ucs.parquet"))
    got = {(x["lemma_a"], x["lemma_b"]): x["n_ab"] for x in queries.queries()["p4_pares"](spark, str(tmp_path)).collect()}
    assert got["a", "b"] == 2 and got["a", "todo"] == 2 and len(got) == 8
    assert queries.queries()["p4_found"](spark, str(tmp_path)).count() == 0


def test_pairs_of_nothing(spark):
    frame = spark.createDataFrame([], "lemmas array<string>")
    assert cooc.pair_surprise(frame, "lemmas", "lemma", 0).count() == 0
    assert cooc.pair_surprise(spark.createDataFrame([(None,), ([],)], "lemmas array<string>"), "lemmas", "lemma", 2).count() == 0


def test_null_keeps_degrees_and_sizes():
    import numpy as np

    degrees, items = np.array([2.0, 5.0, 20.0]), np.array([50.0, 20.0, 3.0])
    sizes, records = np.array([1.0, 4.0]), np.array([60.0, 50.0])
    assert (degrees * items).sum() == (sizes * records).sum()
    x, y = cooc.fit_null(degrees, items, sizes, records)
    p = np.outer(x, y) / (1 + np.outer(x, y))
    assert np.allclose((p * records).sum(axis=1), degrees, rtol=1e-3) and np.allclose((p * items[:, None]).sum(axis=0), sizes, rtol=1e-3)


def test_tail_against_exact_convolution():
    import numpy as np

    q, weights = np.array([[0.01, 0.05]]), np.array([80.0, 20.0])
    exact = np.array([1.0])
    for p, m in zip(q[0], weights):
        for _ in range(int(m)):
            exact = np.convolve(exact, [1 - p, p])
    for k in (4, 6, 9):
        got = cooc.poisson_binomial_tail(q, weights, np.array([float(k)]))[0]
        assert got == pytest.approx(exact[k:].sum(), rel=0.05)
