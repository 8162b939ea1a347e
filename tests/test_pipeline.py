import numpy as np
import pytest
from pyspark.sql import functions as F

from tesela.operators import coref, grammar, pipeline, segmentation, space


@pytest.fixture(scope="module")
def units(spark):
    r = np.random.default_rng(1)
    rows = [(f"{d}_{i}", d, i, [f"{'ab'[d % 2]}{r.integers(12)}" for _ in range(6)] + ["comun"]) for d in range(8) for i in range(30)]
    return spark.createDataFrame(rows, "uce_id string, doc_id int, local_idx int, stems array<string>")


def test_double_classification_is_stable_on_blocks(units):
    stable, ari = pipeline.double_classification(units)
    kinds = {}
    for r in stable.where("estable").collect():
        kinds.setdefault(r["clase"], set()).add(int(r["uce_id"].split("_")[0]) % 2)
    assert ari > 0.8 and len(kinds) >= 2 and all(len(k) == 1 for k in kinds.values())
    assert pipeline.score(units, stable, ari) > 2


def test_search_keeps_the_best(units):
    calls = []

    def run(u, **settings):
        calls.append(settings)
        return u.select("uce_id", (F.col("doc_id") % 2).alias("clase"), F.lit(True).alias("estable")), settings["min_forms"] / 100

    best, top = pipeline.search(units, 4, run=run)
    assert len(calls) <= 4 and best["min_forms"] == max(c["min_forms"] for c in calls) and top > 0


def test_embeddings_and_alignment(spark):
    texts = spark.createDataFrame([("a", "sol y mar"), ("b", "sol y mar"), ("c", None)], "k string, t string")
    got = {r["k"]: r["vec"] for r in pipeline.hashed_embedding(texts, "k", "t").collect()}
    assert got["a"] == got["b"] and len(got["c"]) == 64
    weights = spark.createDataFrame([(u, t, 1.0) for u, ts in (("u", "ab"), ("v", "ab"), ("w", "cd"), ("x", "cd")) for t in ts], "u string, termino string, ppmi double")
    vec = {r["word"]: np.array(r["vec"]) for r in space.term_embeddings(weights, "u", 2).collect()}
    cos = lambda a, b: vec[a] @ vec[b] / np.linalg.norm(vec[a]) / np.linalg.norm(vec[b])
    assert cos("a", "b") > 0.999 and abs(cos("a", "c")) < 1e-6
    source = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("z", [1.0, 1.0])], "word string, vec array<double>")
    target = spark.createDataFrame([("a", [0.0, 2.0]), ("b", [3.0, 0.0])], "word string, vec array<double>")
    turned = {r["word"]: r["vec"] for r in space.aligned(source, target, 2, 2).collect()}
    assert turned["z"] == pytest.approx([3.0, 2.0], abs=1e-4)


def test_similar_pairs_recall(spark):
    r = np.random.default_rng(3)
    base = r.standard_normal((40, 16))
    rows = [(2 * i + k, [float(x) for x in v + (r.normal(0, 0.15, 16) if k else 0)]) for i, v in enumerate(base) for k in (0, 1)]
    rows += [(900, None), (901, [0.0] * 16), (902, [1.0])]
    got = {(x["key_1"], x["key_2"]) for x in coref.similar_pairs(spark.createDataFrame(rows, "k int, v array<double>"), "k", "v", 0.9).collect()}
    x = np.array([v for _, v in rows[:80]])
    x /= np.linalg.norm(x, axis=1)[:, None]
    want = {(i, j) for i in range(80) for j in range(i + 1, 80) if x[i] @ x[j] >= 0.9}
    assert got <= want and len(got) >= 0.9 * len(want) > 20


def test_shifts_and_folds(spark):
    rows = [(1, 0, [1.0, 0.0], {"a": 1.0}, True), (1, 1, [1.0, 0.1], {"a": 1.0}, True), (1, 2, [0.0, 1.0], {"a": 1.0}, True), (1, 3, [0.0, 1.0], {"b": 1.0}, False)]
    marked = segmentation.shifts(spark.createDataFrame(rows, "d int, i int, v array<double>, p map<string,double>, s boolean"), "d", "i", "v", "p", "s")
    assert [r["segmento"] for r in segmentation.progressive(marked, "d", "i").orderBy("i").collect()] == [0, 0, 1, 1]
    assert segmentation.overflow_pieces(250, 100, [0.1, 0.9, 0.2]) == [[0, 1], [2], [3]] and segmentation.overflow_pieces(50, 100, [0.5]) == [[0, 1]]


def test_projection_and_profiles(spark):
    texts = spark.createDataFrame([(1, "u", "Bueno, la casa grande ardía mucho.")], "d int, u string, t string")
    t = grammar.rule_tokens(texts, "d", "u", "t")
    got = grammar.unit_projection(t).collect()[0]
    assert got["tokens"] == ["Bueno", "la", "casa", "grande", "ardía", "mucho"] and "casa" in got["lemmas"] and "la" in got["marcadores"]
    assert [r["lower"] for r in grammar.pivot_starts(t).where("inicia").collect()] == ["bueno"]
    assert grammar.dependency_profile(t).collect()[0]["perfil"] == {"dep": 1.0} and grammar.has_substance(t).count() == 1
    vectors = spark.createDataFrame([("casa", [1.0])], "word string, vec array<double>")
    assert max(r["densidad"] for r in grammar.context_embedding(t, vectors, 1).collect()) == 1.0


def test_frames_written_back(spark):
    frames = spark.createDataFrame([(1, "u", 0, -1, "ser", "x", "AGENT", "Act", False, "e"), (1, "u", 1, -1, "ir", None, "AGENT", "Pass", True, "e")], "doc_id int, uce_id string, frame_idx int, cluster_id int, verb_lemma string, object_lemma string, role string, voice string, negated boolean, entity_lemma string").withColumn("entity_text", F.col("entity_lemma"))
    new = coref.with_clusters(frames, spark.createDataFrame([(1, "u", 1, 4)], "doc_id int, uce_id string, frame_idx int, cluster_id int"))
    assert {r["frame_idx"]: r["cluster_id"] for r in new.collect()} == {0: -1, 1: 4}
    s = {r["cluster_id"]: r for r in coref.cluster_summary(new, "cluster_id").collect()}
    assert s[4]["top_verb_lemma"] == ["ir"] and s[4]["n_negados"] == 1 and s[-1]["por_voice"] == {"Act": 1}
    more = coref.expansions(frames, spark.createDataFrame([("e", "f")], "key_1 string, key_2 string"))
    assert more.where("is_expansion").count() == 2


def test_vectors_of_every_term_both_ways(spark):
    """Held by the driver or joined, the vectors are those of the singular value decomposition."""
    r = np.random.default_rng(5)
    table = (r.random((40, 12)) < 0.4) * r.random((40, 12))
    rows = [(int(u), f"w{t:02}", float(table[u, t])) for u, t in zip(*np.nonzero(table))]
    weights = spark.createDataFrame(rows, "u int, termino string, ppmi double")
    _, sigma, vt = np.linalg.svd(table)
    for held in (100, 0):
        vectors, values = space.leading_vectors(weights, "u", "termino", "ppmi", 2, extra=4, held=held)
        got = {x["termino"]: x["v"] for x in vectors.collect()}
        mine = np.array([got[f"w{t:02}"] for t in range(12)])
        assert np.allclose(values, sigma[:2], rtol=1e-4)
        for a in range(2):
            assert abs(mine[:, a] @ vt[a]) > 0.999 and mine[np.abs(mine[:, a]).argmax(), a] > 0
    empty = space.leading_vectors(weights.limit(0), "u", "termino", "ppmi", 2)
    assert empty[0].count() == 0 and len(empty[1]) == 0


def test_correspondence_of_every_term(spark):
    """Axes of the whole binary table against the decomposition of its standardised residuals."""
    from tesela.operators import factor

    r = np.random.default_rng(6)
    z = r.random((30, 9)) < 0.4
    z[:, 0] |= ~z.any(axis=1)
    rows = [(int(u), f"w{t}") for u, t in zip(*np.nonzero(z))]
    units_, terms_, inertia = factor.multiple_correspondence(spark.createDataFrame(rows, "u int, termino string"), "u")
    p = z / z.sum()
    a, b = p.sum(axis=1), p.sum(axis=0)
    s = (p - np.outer(a, b)) / np.sqrt(np.outer(a, b))
    left, sigma, vt = np.linalg.svd(s)
    assert np.allclose(inertia, sigma[:2] ** 2, rtol=1e-3)
    got = {(x["termino"], x["eje"]): x["coordenada"] for x in terms_.collect()}
    assert len(got) == 18
    mine = np.array([got[f"w{t}", 0] for t in range(9)])
    want = vt[0] / np.sqrt(b) * sigma[0]
    assert np.allclose(np.abs(mine), np.abs(want), atol=1e-3)
    assert units_.count() == 60
    assert factor.multiple_correspondence(spark.createDataFrame([], "u int, termino string"), "u")[1].count() == 0


@pytest.mark.parametrize("block", [4096, 16])
def test_similar_pairs_lose_none(spark, block):
    """At the threshold in use, every pair that brute force finds, whatever the blocks."""
    r = np.random.default_rng(7)
    x = r.standard_normal((90, 6))
    rows = [(i, [float(v) for v in x[i]]) for i in range(90)] + [(200, [float(v) for v in x[0]]), (201, [0.0] * 6), (202, None)]
    got = coref.similar_pairs(spark.createDataFrame(rows, "k int, v array<double>"), "k", "v", 0.72, top=90, block=block).collect()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {(i, j) for i in range(90) for j in range(i + 1, 90) if u[i] @ u[j] >= 0.72}
    assert {(g["key_1"], g["key_2"]) for g in got} == want and len(want) > 20
    assert coref.similar_pairs(spark.createDataFrame([], "k int, v array<double>"), "k", "v").count() == 0


@pytest.mark.parametrize("ppmi", [False, True])
def test_double_classification_reads_its_units_once(spark, units, ppmi):
    """Both sizes come from one written table, and empty, null and blank forms count as forms but are no terms."""
    odd = spark.createDataFrame([("x_1", 90, 0, ["", None, "a1"]), ("x_2", 90, 1, None), ("x_3", 91, 0, [])], units.schema)
    frame, count = units.union(odd), spark.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            count.add(batch.num_rows)
            yield batch

    stable, ari = pipeline.double_classification(frame.mapInArrow(run, frame.schema), ppmi=ppmi)
    assert stable.count() >= 240 and count.value == 243
    assert ari > 0.8 and {r["clase"] for r in stable.where("uce_id = 'x_1'").collect()} <= {r["clase"] for r in stable.collect()}
