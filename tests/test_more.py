import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, __file__.rpartition("/")[0])

from test_grammar import FIN, frame  # noqa: E402

from tesela.operators import coref, factor, grammar, lexical, network, segmentation, space, terms  # noqa: E402
from tesela.sources import readers  # noqa: E402
from tesela.streaming import incremental  # noqa: E402


@pytest.fixture(scope="module")
def tokens(spark):
    return frame(
        spark,
        [("Las", "el", "DET", "det", 1), ("casas", "casa", "NOUN", "nsubj", 3, {"Gender": "Fem", "Number": "Plur"}), ("están", "estar", "AUX", "cop", 3, FIN), ("pintado", "pintar", "VERB", "root", 3, {"VerbForm": "Part", "Gender": "Masc", "Number": "Sing"}), ("ayer", "ayer", "ADV", "advmod", 3)],
    )


def test_rules_over_heads(spark, tokens):
    assert [r["text"] for r in grammar.participle_agreement(tokens).collect()] == ["pintado"]
    w = grammar.adverb_window(tokens).collect()[0]
    assert (w["desde"], w["hasta"]) == (1, 4)
    lexicon = spark.createDataFrame([("casas", 1e6 / 8)], "word string, subtlwf double")
    bits = grammar.surprisal_map(tokens, lexicon).collect()[0]["sorpresa"]
    assert bits[1] == pytest.approx(3.0) and bits[3] > 20
    scopes = spark.createDataFrame([(1, "u", 0, 3, 4)], "doc_id int, uce_id string, sent_id int, lo int, hi int")
    assert {r["text"]: r["negacion"] for r in grammar.in_negation(grammar.verbs(tokens), scopes).collect()} == {"están": False, "pintado": True}
    assert grammar.ancestors(tokens).where("i = 0 and a = 3").collect()[0]["pasos"] == 2


def test_chain_products(spark):
    rows = [(1, "u", 0, "c", "ser", "x", "AGENT", 2, False, 0, 4, 5, 8, 9, 12), (1, "v", 1, "c", "ir", None, "AGENT", 2, True, 20, 24, 25, 28, 0, 0), (2, "w", 2, "c", "ser", "y", "PATIENT", 3, False, 0, 1, 2, 3, 4, 5)]
    f = spark.createDataFrame(rows, "doc_id int, uce_id string, frame_idx int, chain string, verb_lemma string, object_lemma string, role string, cluster_id int, is_expansion boolean, entity_start int, entity_end int, verb_start int, verb_end int, object_start int, object_end int")
    s = coref.chain_summary(f, "chain", "cluster_id").collect()[0]
    assert (s["n_frames"], s["clase"], s["rol"], s["verbos"], s["n_expansiones"]) == (3, 2, "AGENT", ["ir", "ser"], 1)
    edges = {(r["a"], r["b"]): r["peso"] for r in coref.frame_graph(f, "frame_idx", "doc_id", "chain").collect()}
    assert edges == {("0", "1"): 2.0, ("1", "2"): 2.0}
    ranges = spark.createDataFrame([(1, 6, 7)], "doc_id int, lo int, hi int")
    assert [r["frame_idx"] for r in coref.frames_in_range(f, ranges).collect()] == [0]
    chains = spark.createDataFrame([("Ana ", 1, 3), ("ana", 2, 2)], "r string, d int, n int")
    assert tuple(coref.cross_document(chains, "r", "d", "n").collect()[0]) == ("ana", 2, 5)
    segments = spark.createDataFrame([(1, 0, 0, 10), (1, 1, 10, 20)], "doc_id int, segmento int, s_start int, s_end int")
    mentions = spark.createDataFrame([(1, 7, 2, 3), (1, 7, 12, 13)], "doc_id int, chain_id int, start_char int, end_char int")
    assert [tuple(r) for r in coref.bridged_segments(mentions, segments).collect()] == [(1, 0)]


def test_space_products(spark):
    centroids = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "k int, centroide array<double>")
    lexicon = spark.createDataFrame([("a", [1.0, 0.1], 0.9), ("b", [0.0, 1.0], 0.9), ("usado", [1.0, 0.0], 0.9)], "word string, vec array<double>, cd double")
    got = space.latent_vocabulary(lexicon, spark.createDataFrame([("usado",)], "termino string"), centroids, "k", 1).collect()
    assert {r["clase"]: r["word"] for r in got} == {1: "a", 2: "b"}
    scored = spark.createDataFrame([("x", 1, 9.0, 0.5, True), ("y", 1, 5.0, 0.4, True), ("z", 1, 7.0, -0.4, True)], "termino string, k int, chi2_yates double, phi double, significativo boolean")
    assert {r["k"]: r["terminos"] for r in space.centroid_export(centroids, scored, "k").collect()} == {1: ["x", "y"], 2: None}
    edges = space.constraint_graph(scored, "k").collect()
    assert [tuple(r) for r in edges] == [("x", "y", 5.0)]
    words = spark.createDataFrame([("u", "a"), ("u", "b"), ("v", "nada")], "u string, termino string")
    vec = space.weighted_unit_vectors(words, lexicon.select("word", "vec"), "u", 2).collect()
    assert len(vec) == 1 and sum(x * x for x in vec[0]["vec"]) == pytest.approx(1)
    known = spark.createDataFrame([(1, [2.0, 0.0], 3.0), (1, [0.0, 2.0], 1.0), (None, [1.0, 1.0], 1.0), (-1, [1.0, 1.0], 1.0)], "k int, v array<double>, w double")
    assert space.class_centroids(known, "k", "v", 2, "w").collect()[0]["centroide"] == [1.5, 0.5]


def test_network_products(spark):
    edges = spark.createDataFrame([("a", "b", 4.0), ("a", "z", 2.0)], "a string, b string, peso double")
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "word string, vec array<double>")
    assert {r["b"]: r["peso_semantico"] for r in network.reweighted(edges, vectors, "peso").collect()} == {"b": 2.0, "z": 1.0}
    inc = spark.createDataFrame([(f"u{i}", t) for i in range(30) for t in ("a", "b")] + [(f"v{i}", "c") for i in range(30)], "u string, termino string")
    v = lexical.vocabulary(inc, "u")
    got = network.association(network.pair_counts(inc, "u"), v, 60, fisher=0.01).collect()
    assert len(got) == 1 and got[0]["p"] < 1e-10 and got[0]["pmi"] == pytest.approx(0.954, abs=0.01)
    with pytest.raises(ValueError):
        limit = network.KERNEL_EDGES
        network.KERNEL_EDGES = 1
        try:
            network.communities(edges, "peso")
        finally:
            network.KERNEL_EDGES = limit


def test_ranks_by_group_and_phi_maps(spark):
    rows = [(g, x) for g in "ab" for x in (5, 3, 9)]
    got = {(r["g"], r["x"]): r["n"] for r in lexical.with_rank(spark.createDataFrame(rows, "g string, x int"), [F.col("x")], "n", by="g").collect()}
    assert got == {(g, x): n for g in "ab" for n, x in enumerate((3, 5, 9), 1)}
    assert lexical.with_rank(spark.createDataFrame([], "g string, x int"), [F.col("x")], "n").count() == 0
    inc = spark.createDataFrame([("u", "t"), ("u", "s")], "u string, termino string")
    scored = spark.createDataFrame([("t", 1, 0.5, True), ("s", 1, -0.4, True)], "termino string, k int, phi double, significativo boolean")
    classes = spark.createDataFrame([("u", 1)], "u string, k int")
    assert terms.term_map(inc, classes, scored, "u", "k").collect()[0]["phi_coefficients"] == {"s": -0.4, "t": 0.5}


def test_windows_offsets_and_class_trees(spark):
    units = spark.createDataFrame([(1, i, "x" * 3) for i in range(4)], "d int, i int, t string")
    assert [len(r["ventana"]) for r in segmentation.sliding_windows(units, "d", "i", "t", 3, 8).orderBy("i").collect()] == [3, 7, 7, 7]
    spans = segmentation.global_offsets(spark.createDataFrame([(10, 1, 2)], "b int, s int, e int"), "b", "s", "e").collect()[0]
    assert (spans["s"], spans["e"]) == (11, 12)
    inc = spark.createDataFrame([(f"u{i}", t) for i in range(12) for t in (("a", "b") if i % 2 else ("c",))], "u string, termino string")
    classes = spark.createDataFrame([(f"u{i}", 1 + i % 2) for i in range(12)], "u string, k int")
    scored = terms.characteristic_terms(inc, classes, "u", "k")
    merges = factor.class_dendrogram(inc, scored, classes, "u", "k", 2)
    assert len(merges) == 2 and merges[0][2] == pytest.approx(0) and factor.merge_frame(spark, merges).count() == 2


def test_readers_of_small_files(spark, tmp_path):
    (tmp_path / "cd.csv").write_text("Word;SUBTLCD\nCasa;50\n;1\nmar;x\n", encoding="utf-8")
    assert {r["word"]: r["cd"] for r in readers.contextual_diversity(spark, str(tmp_path / "cd.csv")).collect()} == {"casa": 0.5, "mar": None}
    (tmp_path / "a.json").write_text('{"b": {"role": "r"}, "a": {"disc_cats": ["b"]}}', encoding="utf-8")
    assert [x["name"] for x in readers.agents(str(tmp_path / "a.json"))] == ["a", "b"]
    u = spark.createDataFrame([("x", 2, None, True), ("y", 1, 4, True), ("z", 1, None, False)], "uce_id string, doc_id int, local_idx int, is_stable boolean")
    assert [r["uce_id"] for r in readers.stable_units(u).collect()] == ["y", "x"]


def test_streams_of_terms_and_context_units(spark, tmp_path):
    docs = spark.createDataFrame([(1, "sol y mar", "2024-01-01 10:00:00"), (1, "sol y mar", "2024-01-01 10:00:05"), (2, "sol", "2024-01-01 10:01:00")], "d int, t string, ts string").withColumn("ts", F.to_timestamp("ts"))
    docs.coalesce(1).write.parquet(str(tmp_path / "d"))
    stream = spark.readStream.schema(docs.schema).parquet(str(tmp_path / "d"))
    run = incremental.term_counts(stream, "d", "t", "ts").writeStream.format("memory").queryName("terminos").outputMode("complete").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    run.awaitTermination()
    assert {r["termino"]: r["apariciones"] for r in spark.table("terminos").collect()} == {"sol": 2, "y": 1, "mar": 1}
    units = spark.createDataFrame([(1, i, n) for i, n in enumerate([4, 5, 3, 6, 2])], "d int, i int, n int")
    units.coalesce(1).write.parquet(str(tmp_path / "u"))
    stream = spark.readStream.schema(units.schema).parquet(str(tmp_path / "u"))
    run = incremental.context_unit_stream(stream, "d", "i", "n").writeStream.format("memory").queryName("ucs_flujo").outputMode("append").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    run.awaitTermination()
    assert [r["uc_idx"] for r in spark.table("ucs_flujo").orderBy("i").collect()] == [0, 0, 0, 1, 1]
