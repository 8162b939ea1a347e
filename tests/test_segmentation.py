import numpy as np
import pandas as pd

from tesela.operators import segmentation as seg


def test_reinert_cut_of_the_fixture():
    weights = np.full(100, 0.01)
    weights[38], weights[40] = 6.0, 1.0
    assert seg.cut_places(weights) == [(0, 39), (39, 80), (80, 100)]
    assert seg.cut_places(np.array([])) == [] and seg.cut_places(np.ones(56)) == [(0, 56)]


def test_units_keep_the_text(spark):
    text = ("Una frase corta, otra más larga; y la tercera. " * 30).strip()
    rows = [("a", text), ("b", None), ("c", ""), ("d", "dos palabras")]
    got = seg.elementary_units(spark.createDataFrame(rows, "k string, texto string"), "k", "texto").collect()
    assert {r["k"] for r in got} == {"a"} and all(text[r["start_char"] : r["end_char"]] == r["texto"] for r in got)
    assert [r["local_idx"] for r in sorted(got, key=lambda r: r["start_char"])] == list(range(len(got)))


def test_context_units_of_the_fixture(spark):
    rows = [(1, i, n) for i, n in enumerate([4, 5, 3, 6, 2])] + [(2, 0, None)]
    got = seg.context_units(spark.createDataFrame(rows, "doc int, i int, n int"), "doc", "i", "n", 10).orderBy("doc", "i").collect()
    assert [(r["doc"], r["uc_idx"]) for r in got] == [(1, 0)] * 3 + [(1, 1)] * 2 + [(2, 0)]


def test_context_units_by_blocks_are_the_same(spark):
    r = np.random.default_rng(4)
    rows = [(d, i, int(r.integers(0, 9))) for d in range(3) for i in range(200 if d else 7)]
    frame = spark.createDataFrame(rows, "doc int, i int, n int")
    whole = sorted(map(tuple, seg.context_units(frame, "doc", "i", "n", 10).select("doc", "i", "uc_idx").collect()))
    assert sorted(map(tuple, seg.context_units(frame, "doc", "i", "n", 10, block=16).select("doc", "i", "uc_idx").collect())) == whole
    for d in range(3):
        at, uc = 0, 0
        for doc, i, n in rows:
            if doc == d:
                assert (d, i, uc) in whole
                at += n
                if at >= 10:
                    at, uc = 0, uc + 1


def test_smoothing_of_the_fixture(spark):
    frame = spark.createDataFrame([(1, i, float(s)) for i, s in enumerate([1, 0, 1, 0])], "d int, i int, s double")
    got = [r["suave"] for r in seg.smoothed(frame, "d", "i", "s").orderBy("i").collect()]
    assert np.allclose(got, [2 / 3, 2 / 3, 1 / 3, 1 / 3])


def test_boundaries(spark):
    scores = [0.9, 0.2, 0.8, 0.8, 0.9, 0.1, 0.9]
    rows = [(1, i, s, "a" if i < 4 else "b") for i, s in enumerate(scores)]
    got = seg.boundaries(spark.createDataFrame(rows, "d int, i int, s double, sec string"), "d", "i", "s", "sec").orderBy("i").collect()
    assert [r["i"] for r in got if r["frontera"]] == [1, 3, 5, 6]
    ranges = seg.segment_ranges(spark.createDataFrame([(r["d"], r["i"], r["segmento"]) for r in got], "d int, i int, segmento int"), "d", "i").orderBy("segmento").collect()
    assert [(r["desde"], r["hasta"]) for r in ranges] == [(0, 1), (2, 3), (4, 5), (6, 6)]


def test_merges():
    v = np.array([[1.0, 0], [0.9, 0.1], [0, 1.0], [0, 1.0]])
    assert seg.merge_small(np.array([5.0, 1, 5, 5]), v, 2) == [[0, 1], [2], [3]]
    assert seg.merge_smaller_neighbour([5, 1, 3], 2) == [[0], [1, 2]]
    assert seg.merge_smaller_neighbour([3, 1, 3], 2) == [[0, 1], [2]]
    assert seg.merge_lowest([0.5, 0.1, 0.9], 2) == [[0, 1, 2], [3]]
    assert seg.bridge_merge([True, False, True]) == [[0, 1], [2, 3]]


def test_recursive_and_linear_groups_find_the_topic_change():
    r = np.random.default_rng(0)
    a, b = np.array([1.0, 0, 0]), np.array([0, 1.0, 0])
    v = np.array([x + r.normal(0, 0.05, 3) for x in [a] * 6 + [b] * 6])
    assert any(g[0] == 6 for g in seg.recursive_groups(v)) and seg.linear_groups(v) == [list(range(6)), list(range(6, 12))]
    assert sorted(i for g in seg.recursive_groups(v) for i in g) == list(range(12))
    assert seg.recursive_groups(np.zeros((0, 3))) == []


def test_relocked_offsets(spark):
    text = "uno dos. tres uno dos. fin"
    units = spark.createDataFrame([(1, 0, "uno dos."), (1, 1, "tres"), (1, 2, "uno dos."), (1, 3, "nada")], "doc int, i int, u string")
    got = seg.relocked(units, spark.createDataFrame([(1, text)], "doc int, t string"), "doc", "i", "u", "t").orderBy("i").collect()
    assert [r["inicio"] for r in got] == [0, 9, 14, -1]


def test_entity_boundary_and_sections(spark):
    rows = [(1, 0, [1.0, 0.0], ["x"], 5), (1, 1, [0.0, 1.0], ["x"], 5), (1, 2, [0.0, 1.0], ["y"], 2)]
    got = seg.entity_boundary(spark.createDataFrame(rows, "d int, i int, v array<double>, e array<string>, c int"), "d", "i", "v", "e", "c").orderBy("i").collect()
    assert got[1]["puntaje"] == 0.5 and got[2]["puntaje"] == -1.0
    numbered = seg.section_numbers(spark.createDataFrame([(1, 0, "b"), (1, 1, None), (1, 2, "b")], "d int, i int, seccion string"), "d", "i").orderBy("i").collect()
    assert [(r["seccion"], r["section_id"]) for r in numbered] == [("b", 0), ("Sin_Seccion", 1), ("b", 0)]


def test_assembled_units_are_a_partition(spark):
    rows = [(1, i, f"u{i}", [f"l{i}"], 4) for i in range(7)]
    frame = spark.createDataFrame(rows, "doc_id int, local_idx int, uce_id string, lemmas array<string>, n int")
    got = seg.assembled(seg.context_units(frame, "doc_id", "local_idx", "n", 10), "doc_id", "local_idx", None, "lemmas").orderBy("uc_idx").collect()
    assert [u for r in got for u in r["uce_ids"]] == [f"u{i}" for i in range(7)] and got[0]["uc_id"] == "uc_1_0"
    assert isinstance(pd.DataFrame(got), pd.DataFrame)


def test_blocks_of_a_document_give_what_it_gives_whole(spark):
    """One document holds half of all rows; parted into blocks of five units it has the same results."""
    import random

    from pyspark.sql import functions as F

    from tesela.operators import segmentation

    r = random.Random(3)
    rows = []
    for d, n in ((1, 60), (2, 25), (3, 1), (4, 34)):
        for i in range(n):
            rows.append((d, i, [r.random(), r.random()], r.random(), f"s{i // 9}", [r.choice("abcd") for _ in range(r.randrange(4))], r.randrange(8), r.choice("xy") * 3, r.random() < 0.3))
    u = spark.createDataFrame(rows, "d int, i int, v array<double>, c double, s string, e array<string>, k int, t string, cambio_de_tema boolean").checkpoint()
    made = {
        "shift": lambda b: segmentation.topic_shift(u, "d", "i", "v", b).select("d", "i", "topic_shift"),
        "cohesion": lambda b: segmentation.cohesion(u, "d", "i", "v", "e", 0.3, b).select("d", "i", "cohesion"),
        "smooth": lambda b: segmentation.smoothed(u, "d", "i", "c", 3, b).select("d", "i", "suave"),
        "smooth5": lambda b: segmentation.smoothed(u, "d", "i", "c", 5, b).select("d", "i", "suave"),
        "cut": lambda b: segmentation.boundaries(u, "d", "i", "c", "s", 0.6, block=b).select("d", "i", "frontera", "segmento"),
        "entity": lambda b: segmentation.entity_boundary(u, "d", "i", "v", "e", "k", b).select("d", "i", "puntaje"),
        "sliding": lambda b: segmentation.sliding_windows(u, "d", "i", "t", 3, 8, b).select("d", "i", "ventana"),
        "progressive": lambda b: segmentation.progressive(u, "d", "i", b).select("d", "i", "segmento"),
        "places": lambda b: segmentation.interval_starts(u, "d", "i", "t", 2, b).select("d", "i", "s_start", "s_end"),
        "context": lambda b: segmentation.context_units(u, "d", "i", "k", 10, b).select("d", "i", "uc_idx"),
    }
    plain = lambda df: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect())
    for name, make in made.items():
        whole = plain(make(100_000))
        assert len(whole) == len(rows) and plain(make(5)) == whole, name
    # the moving mean against its definition: the edge value stands for what is missing
    c = [x[3] for x in rows if x[0] == 1]
    padded = [c[0]] * 2 + c + [c[-1]] * 2
    got = {r["i"]: r["suave"] for r in made["smooth5"](5).where(F.col("d") == 1).collect()}
    assert all(abs(got[i] - sum(padded[i : i + 5]) / 5) < 1e-9 for i in range(len(c)))
