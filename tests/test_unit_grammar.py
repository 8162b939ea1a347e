"""The batch kernel of the built-in tagger against the rules over a token table."""

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesela.operators import grammar, unit_grammar
from tesela.plans import registry
import tesela.plans  # noqa: F401

TEXTS = [
    "No vino nadie. Se venden casas, o sea, no se había podido vender nada más que tres cosas; en fin.",
    "Bueno, pues nada, ya ves: lo que pasa es que quiere darlos sin embargo también. ¿Y ni un mucho?",
    "entonces", "¡¡!!", "", "   ", "Él se lavaron las manos grandes y cantaba. No ni jamás tampoco. Ninguna 3,5 casa rojiza",
    "o sea o sea por lo", "tanto sobre todo. 世界 ́suelto İstanbul por\nun lado bien", "Dejó de ir cantando porque la cosa es que además. asimismo no. Fue, además",
]


@pytest.fixture(scope="module")
def texts(spark):
    rows = [(1, f"u{k}", t) for k, t in enumerate(TEXTS + [" ".join(TEXTS) * 30])]
    return spark.createDataFrame(rows, "doc_id int, uce_id string, texto string").coalesce(1)


def listed(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_marker_density_is_that_of_the_token_table(texts):
    t = grammar.rule_tokens(texts, "doc_id", "uce_id", "texto")
    want = grammar.marker_density(t, grammar.discourse_markers(t)).select("uce_id", "palabras", "marcadores")
    assert listed(unit_grammar.marker_counts(texts, "uce_id", "texto")) == listed(want)


def test_summary_is_that_of_the_token_table(texts):
    t = grammar.shallow_parse(grammar.rule_tokens(texts, "doc_id", "uce_id", "texto"))
    place = ["doc_id", "uce_id", "i"]
    found = grammar.annotations(
        negacion=grammar.negations(t).select(*place, "tipo"), verbo=grammar.verbs(t).select(*place, "voz", "perifrasis"),
        cuantificador=grammar.quantifiers(t).select(*place, "tipo"), marcador=grammar.discourse_markers(t).select(*place, "categoria", "posicion"),
    )
    assert listed(unit_grammar.summary(texts, "texto")) == listed(grammar.feature_counts(found))


def test_negated_verbs_are_those_of_the_token_table(texts):
    t = grammar.shallow_parse(grammar.rule_tokens(texts, "doc_id", "uce_id", "texto")).withColumn("char_start", F.col("i"))
    scopes = grammar.negations(t).select("doc_id", "uce_id", "sent_id", F.col("i").alias("lo"), (F.col("i") + 5).alias("hi"))
    want = grammar.in_negation(grammar.verbs(t), scopes).groupBy("pos", "negacion").agg(F.count(F.lit(1)).alias("n"))
    assert listed(unit_grammar.negated_verbs(texts, "texto")) == listed(want)


@pytest.mark.parametrize("name", ["grammar_summary", "marker_density", "verbs_under_negation"])
def test_no_token_table_is_written(spark, texts, tmp_path, monkeypatch, name):
    texts.withColumn("doc_id", F.col("doc_id").cast("long")).write.parquet(str(tmp_path / "uces.parquet"))

    def refused(*_):
        raise AssertionError("tokens are written")

    monkeypatch.setattr(DataFrame, "checkpoint", refused)
    assert registry.queries()[name](spark, str(tmp_path)).count() > 0
