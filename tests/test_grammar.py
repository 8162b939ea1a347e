import pytest

from tesela.operators import coref, grammar

SCHEMA = "doc_id int, uce_id string, sent_id int, i int, text string, lower string, lemma string, pos string, dep string, head_i int, morph map<string,string>, char_start int, char_end int, is_stop boolean, is_punct boolean, is_alpha boolean"


def frame(spark, *sentences):
    rows = []
    for s, tokens in enumerate(sentences):
        for i, (text, lemma, pos, dep, head, *morph) in enumerate(tokens):
            rows.append((1, "u", s, i, text, text.lower(), lemma, pos, dep, head, morph[0] if morph else {}, i, i + 1, False, pos == "PUNCT", pos != "PUNCT"))
    return spark.createDataFrame(rows, SCHEMA)


FIN = {"VerbForm": "Fin", "Person": "3", "Number": "Sing", "Mood": "Ind", "Tense": "Past"}


def test_negation_of_the_fixture(spark):
    t = frame(spark, [("No", "no", "ADV", "advmod", 1), ("vino", "venir", "VERB", "root", 1, FIN), ("nadie", "nadie", "PRON", "nsubj", 1)])
    got = grammar.negations(t).collect()
    assert len(got) == 1 and got[0]["tipo"] == "NEGACION_VERBAL" and got[0]["alcance"] == "vino" and got[0]["npis"] == ["nadie"]
    assert grammar.unlicensed_npis(t).count() == 0
    p = grammar.pronouns(t).collect()
    assert [(r["tipo"], r["text"], r["referencial"]) for r in p] == [("EXPLICITO", "nadie", False)]


def test_unlicensed_and_repaired(spark):
    t = frame(spark, [("Vino", "venir", "VERB", "root", 0, FIN), ("nadie", "nadie", "PRON", "nsubj", 0)])
    assert [r["text"] for r in grammar.unlicensed_npis(t).collect()] == ["nadie"]
    loose = frame(spark, [("No", "no", "ADV", "advmod", 1), ("vi", "ver", "VERB", "root", 1, FIN), ("casa", "casa", "NOUN", "obj", 1), ("nada", "nada", "PRON", "det", 2)])
    assert {r["i"]: r["head_i"] for r in grammar.repaired_npis(loose).collect()}[3] == 1


def test_verbs(spark):
    t = frame(
        spark,
        [("Se", "se", "PRON", "expl:pass", 1), ("venden", "vender", "VERB", "root", 1, {**FIN, "Number": "Plur"}), ("casas", "casa", "NOUN", "nsubj", 1)],
        [("Quiere", "querer", "VERB", "root", 0, FIN), ("darlos", "dar", "VERB", "xcomp", 0, {"VerbForm": "Inf"})],
    )
    got = {r["text"]: r for r in grammar.verbs(t).collect()}
    assert got["venden"]["voz"] == "PASIVA_REFLEJA" and got["Quiere"]["perifrasis"] and got["Quiere"]["sujetos"] == 1 and got["darlos"]["subordinado"] and got["venden"]["aspecto"] == "Perf"
    kinds = {(r["tipo"], r["subtipo"]) for r in grammar.pronouns(t).collect()}
    assert ("ENCLITICO", "los") in kinds and ("NULO", "3Sing") in kinds


def test_markers_adverbs_quantifiers(spark):
    t = frame(spark, [("O", "o", "CCONJ", "cc", 5), ("sea", "ser", "VERB", "fixed", 0), (",", ",", "PUNCT", "punct", 5), ("muchas", "mucho", "DET", "det", 4), ("casas", "casa", "NOUN", "nsubj", 5), ("arden", "arder", "VERB", "root", 5, FIN), ("de", "de", "ADP", "case", 7), ("repente", "repente", "NOUN", "obl", 5), (".", ".", "PUNCT", "punct", 5), ("entonces", "entonces", "ADV", "advmod", 5)])
    marks = {(r["frase"], r["categoria"], r["posicion"]) for r in grammar.discourse_markers(t).collect()}
    assert ("o sea", "REFORMULADORES", "INICIO") in marks and ("entonces", "CONECTORES", "INICIO") in marks
    assert [(r["frase"], r["categoria"]) for r in grammar.adverbs(t).collect()] == [("de repente", "tiempo")]
    q = grammar.quantifiers(t).collect()
    assert [(r["cuantificador"], r["tipo"], r["cuantificado"]) for r in q] == [("muchas", "PROPORCIONAL", "casas")]
    assert grammar.marker_density(t, grammar.discourse_markers(t)).collect()[0]["densidad"] == pytest.approx(2 / 8 * 100)


def test_insubordination_rarities_complexity(spark):
    t = frame(
        spark,
        [("Que", "que", "SCONJ", "mark", 1), ("venga", "venir", "VERB", "root", 1, FIN)],
        [("dijo", "decir", "VERB", "root", 0, FIN), ("de", "de", "ADP", "mark", 0), ("que", "que", "SCONJ", "fixed", 1), ("sí", "sí", "INTJ", "ccomp", 0), ("detrás", "detrás", "ADV", "advmod", 0), ("mío", "mío", "ADJ", "amod", 4)],
    )
    assert [(r["apertura"], r["funcion"]) for r in grammar.insubordinations(t).collect()] == [("que", "EXCLAMATIVA_JUSIVA")]
    assert {r["patron"] for r in grammar.rarities(t).collect()} == {"DEQUEISMO", "POSESIVO_POSPUESTO"}
    c = grammar.complexity(t).collect()[0]
    assert c["profundidad"] == 2 and c["oraciones"] == 2 and c["recursividad"] == 1
    assert {(r["lower"], r["tipo"]) for r in grammar.subordinations(t).collect()} == {("que", "completiva")}


def test_frames(spark):
    t = frame(spark, [("Ana", "Ana", "PROPN", "nsubj", 2), ("no", "no", "ADV", "advmod", 2), ("compró", "comprar", "VERB", "root", 2, FIN), ("pan", "pan", "NOUN", "obj", 2), ("para", "para", "ADP", "case", 5), ("Luis", "Luis", "PROPN", "obl", 2)])
    got = {r["entity_text"]: r for r in coref.frames(t, grammar.verbs(t)).collect()}
    assert {k: v["role"] for k, v in got.items()} == {"Ana": "AGENT", "pan": "PATIENT", "Luis": "RECIPIENT"} and got["Ana"]["fingerprint"] == "comprar pan Act NEG"


def test_kwic_html_and_profiles(spark):
    texts = spark.createDataFrame([("a", "Sol y sol y luna"), ("b", None)], "k string, t string")
    got = grammar.kwic(texts, "k", "t", "sol", 5).orderBy("hit").collect()
    assert [(r["inicio"], r["izquierda"], r["derecha"]) for r in got] == [(0, "", " y so"), (6, "ol y ", " y lu")]
    spans = spark.createDataFrame([("a", 0, 3, "x"), ("a", 12, 16, "y")], "k string, inicio int, fin int, clase string")
    html = {r["k"]: r["html"] for r in grammar.marked_html(texts, spans, "k", "t").collect()}
    assert html["a"] == '<span class="x">Sol</span> y sol y <span class="y">luna</span>'
    found = spark.createDataFrame([(1, "u", 0, "A"), (1, "u", 1, "A"), (1, "u", 2, "B")], "doc_id int, uce_id string, i int, tipo string")
    counts = grammar.feature_counts(grammar.annotations(neg=found)).collect()
    assert sorted((r["familia"], r["clave"], r["valor"], r["n"]) for r in counts) == [("neg", "tipo", "A", 2), ("neg", "tipo", "B", 1)]


def test_empty_tables(spark):
    t = spark.createDataFrame([], SCHEMA)
    for rule in (grammar.negations, grammar.pronouns, grammar.verbs, grammar.quantifiers, grammar.adverbs, grammar.discourse_markers, grammar.insubordinations, grammar.rarities, grammar.complexity):
        assert rule(t).count() == 0


def test_adverb_model(spark):
    from tesela.operators import adverb_model

    model, accuracy = adverb_model.train(adverb_model.examples(spark))
    assert accuracy > 0.8
    some = spark.createDataFrame([("Lo hizo ayer", "ayer"), ("Dijo torpemente que sí", "torpemente")], "oracion string, adverbio string")
    got = {r["adverbio"]: r for r in adverb_model.classify(some, model).collect()}
    assert got["ayer"]["categoria"] == "tiempo" and got["ayer"]["confianza"] == 1.0 and 0 < got["torpemente"]["confianza"] < 1
