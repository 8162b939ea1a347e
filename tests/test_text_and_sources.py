import json

import pytest
from pyspark.sql import functions as F

from tesela.functions import stemmer
from tesela.functions import text as T
from tesela.operators import agents, coref
from tesela.sources import readers, sinks


def column(spark, values, expression, kind="string"):
    frame = spark.createDataFrame([(v,) for v in values], f"v {kind}")
    return [r[0] for r in frame.select(expression(F.col("v"))).collect()]


def test_keys_and_texts(spark):
    assert column(spark, ["a.txt.json", "b.json", "c.txt", None], T.source_key) == ["a", "b", "c", None]
    assert column(spark, ["﻿“hola”\x00 ‘q’\n"], T.normalize) == ["\"hola\"  'q'\n"]
    assert column(spark, ["  “a”​   b "], T.collapse) == ["'a' b"]
    assert column(spark, ["«Hola, tú»", "...vino…", '"..."'], T.clean_quote) == ["Hola, tú", "vino", ""]
    assert column(spark, ["La casa de el Rey"], lambda c: T.representative(c, True)) == ["casa rey"]
    assert column(spark, ["darlos", "dándome", "a", "sol"], lambda c: T.enclitic(c)["clitico"]) == ["los", "me", None, None]
    assert column(spark, ["del", "sol"], T.expand_contraction) == [["de", "el"], ["sol"]]
    assert column(spark, ["x" * 290 + ". fin", "corto"], T.tail_context) == ["x" * 290 + ". fin", "corto"]
    assert column(spark, ["a" * 400 + ". fin"], T.tail_context) == [" fin"]
    assert column(spark, ["é"], T.compose) == ["é"]


@pytest.mark.parametrize(
    "word,stem",
    [("chicas", "chic"), ("chicharrones", "chicharron"), ("torneos", "torne"), ("torreón", "torreon"), ("comiéndolo", "com"), ("rápidamente", "rapid"), ("biología", "biolog"), ("instituciones", "institu"), ("frecuencia", "frecuenci"), ("activamente", "activ"), ("cantaba", "cant"), ("sigues", "sig")],
)
def test_stems(word, stem):
    assert stemmer.stem(word) == stem


def test_readers(spark, tmp_path):
    (tmp_path / "meta.csv").write_text("Documento Fuente;Edad_Cat;Sexo\nuno.txt;30-44;Mujer\n", encoding="utf-8")
    (tmp_path / "j").mkdir()
    segments = [{"seccion_entrevista": "II", "texto_literal": "Hola."}, {"seccion_entrevista": "TEXTO_NO_ASIGNADO", "texto_literal": "no"}, {"seccion_entrevista": "III", "texto_literal": ""}]
    (tmp_path / "j" / "uno.json").write_text(json.dumps({"output": {"segmentos": segments}}), encoding="utf-8")
    (tmp_path / "j" / "dos.json").write_text(json.dumps({"output": {"segmentos": segments}}), encoding="utf-8")
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "uno.txt").write_text("Texto\nentero", encoding="utf-8")
    got = readers.interviews(spark, str(tmp_path / "meta.csv"), str(tmp_path / "j"), str(tmp_path / "t")).orderBy("doc_id").collect()
    assert [(r["doc_id"], r["llave"], r["texto"]) for r in got] == [(0, "dos", ""), (1, "uno", "Texto\nentero")]
    assert got[1]["meta"]["Sexo"] == "Mujer" and got[0]["meta"] == {} and [s["texto"] for s in got[1]["segmentos"]] == ["Hola."]


def test_frequency_lexicon(spark, tmp_path):
    (tmp_path / "l.csv").write_text("lista;;;\nWord;Freq. count;per million;Log freq;Word;Freq. count;per million;Log freq;CD\ncasa;10;5,5;2.5;mar;x;1;1;50\nsol;1;1;1;casa;20;7;3;0.5\n", encoding="utf-8")
    got = {r["word"]: r for r in readers.frequency_lexicon(spark, str(tmp_path / "l.csv")).collect()}
    assert got["casa"]["freqcount"] == 20 and got["casa"]["zipf"] == 4 and got["mar"]["freqcount"] == 0 and got["mar"]["cd"] == 0.5 and got["sol"]["cd"] == 0.001


def test_collections_and_ids(spark, tmp_path):
    store = str(tmp_path / "s")
    assert readers.collection(spark, store, "x") is None and readers.collection(spark, store, "x", "a int").count() == 0
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    sinks.save(old, store, "x")
    new = spark.createDataFrame([(2, "B"), (3, "C"), (3, "C")], "k int, v string")
    merged = sinks.upserted(readers.collection(spark, store, "x"), new, "k")
    assert sorted(map(tuple, merged.collect())) == [(1, "a"), (2, "B"), (3, "C")]
    ids = spark.createDataFrame([("u1",), (None,), ("123e4567-e89b-12d3-a456-426614174000",)], "i string")
    assert [r[0] for r in ids.select(readers.unit_id(F.col("i"), F.lit(1), F.lit(2), F.lit(3))).collect()] == ["u1", "1_2_3", "1_2_3"]
    sinks.save_settings(str(tmp_path / "p.json"), {"a": 1})
    assert readers.settings(str(tmp_path / "p.json")) == {"a": 1} and readers.settings(str(tmp_path / "none")) == {}


def test_exports(spark):
    assert sinks.as_json(spark.createDataFrame([(1, float("nan"))], "a int, b double")).collect()[0][0] == '{"a":1}'
    units = spark.createDataFrame([(1, 0, "u0", "hola"), (1, 1, "u1", "sol")], "d int, o int, u string, t string")
    got = sinks.tagged_text(units, "d", "o", "u", "t").collect()[0]
    assert got["texto"] == "[u0]: hola\n[u1]: sol\n" and [m["inicio"] for m in got["inicios"]] == [0, 11]
    assert column(spark, [["x" * 300] * 30], sinks.capped, "array<string>") == [["x" * 200] * 20]


def test_quotes_are_placed(spark):
    units = spark.createDataFrame([("u", "Mi casa  era Grande y el sol brillaba mucho ese día")], "uce_id string, texto string")
    quotes = [(1, "«casa  era Grande»"), (2, "CASA ERA GRANDE"), (3, "el sol brilaba mucho ese dia"), (4, "otra cosa muy distinta"), (5, None)]
    got = {r["k"]: r for r in coref.aligned_quotes(spark.createDataFrame([(k, "u", q) for k, q in quotes], "k int, uce_id string, q string"), units, "k", "uce_id", "q", "texto").collect()}
    assert got[1]["inicio"] == 3 and got[1]["metodo"] == "limpia" and got[3]["metodo"] == "difusa" and got[4]["metodo"] == "ninguna" and 5 not in got


def test_chains(spark):
    chains = spark.createDataFrame([(1, 0, "la abuela Rosa"), (1, 1, "abuela Rosa"), (1, 2, "el perro"), (2, 0, "abuela Rosa")], "doc_id int, chain_id int, representative string")
    got = {(r["doc_id"], r["chain_id"]): r["entidad"] for r in coref.merged_chains(chains).collect()}
    assert got[1, 0] == got[1, 1] and len(set(got.values())) == 3
    mentions = spark.createDataFrame([(1, 0, 2, 5), (1, 0, 2, 5), (1, 1, 12, 15)], "doc_id int, chain_id int, start_char int, end_char int")
    units = spark.createDataFrame([(1, "a", 0, 10), (1, "b", 10, 20), (1, "c", 20, 30)], "doc_id int, uce_id string, start_char int, end_char int")
    assert coref.unique_mentions(mentions).count() == 2
    assert coref.coverage(mentions, units).collect()[0]["cobertura"] == pytest.approx(2 / 3)


def test_agents():
    order = agents.run_order([{"name": "c", "disc_cats": ["a", "b"]}, {"name": "b", "disc_cats": ["a"]}, {"name": "a"}])
    assert order == ["a", "b", "c"]
    with pytest.raises(ValueError):
        agents.run_order([{"name": "a", "disc_cats": ["b"]}, {"name": "b", "disc_cats": ["a"]}])
    cut = 'Claro: [{"trait": "ironía", "quote": "no", "confidence": "alta"}, {"trait": "x", "quote": "s'
    assert agents.parse_answer(cut)[0] == {"trait": "ironía", "quote": "no", "confidence": "alta"}
    assert agents.parse_answer("nada") == agents.parse_answer(None) == []
    assert "Texto:\nhola" in agents.prompt({"role": "r"}, "", "hola")
    assert agents.summary_text([("v", "voz", "Act", 3), ("v", "voz", "Pass", 5)]) == "v · voz: Pass (5), Act (3)"


def test_annotation_of_documents(spark):
    docs = spark.createDataFrame([(1, "hola"), (2, None)], "d int, t string")
    agent = {"name": "x"}
    assert agents.annotate(docs, agent, "d", "t").count() == 0
    talk = lambda q: '[{"trait": "a", "quote": "hola"}]' if "hola" in q else "[]"
    assert [tuple(r) for r in agents.annotate(docs, agent, "d", "t", talk).collect()] == [(1, "x", "a", "hola", "baja")]


def test_stream_of_units(spark, tmp_path):
    from tesela.streaming import incremental

    events = spark.createDataFrame([(1, "2024-01-01 10:05:00", "a"), (2, "2024-01-01 10:40:00", "a"), (3, "2024-01-01 11:10:00", "b")], "k int, ts string, c string").withColumn("ts", F.to_timestamp("ts"))
    events.write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "e"))
    run = incremental.windowed_counts(stream, "ts", "c").writeStream.format("memory").queryName("ventanas").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination()
    assert sorted(r["n"] for r in spark.table("ventanas").collect()) == [1, 2]
