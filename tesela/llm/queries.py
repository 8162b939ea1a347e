"""The pN_ queries, each over its whole tables, and their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesela.llm import bpe, chunking, clusters, cooc, lookalike, mixing, pii, sentences, terms
from tesela.llm.common import count_units, distinct_texts, table, texts, units
from tesela.session import ensure_checkpoint_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(function: Callable[[SparkSession, str], DataFrame]):
    @wraps(function)
    def run(spark: SparkSession, folder: str) -> DataFrame:
        ensure_checkpoint_dir(spark)  # the session's folder; its own only where none is set
        return function(spark, folder)

    QUERIES[function.__name__] = run
    return function


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


# --- 1: splitting oversized texts -------------------------------------------------------------


def _configured(spark: SparkSession, folder: str) -> DataFrame:
    parts = []
    for name, key, text in (("uces", "uce_id", "texto"), ("corpus", "doc_id", "texto_completo_txt")):
        parts.append(
            table(spark, folder, name).select(
                F.lit(name).alias("tabla"), F.col(key).cast("string").alias("clave"), F.col(text).alias("texto"), "config_id"
            )
        )
    return parts[0].unionAll(parts[1]).where(F.col("clave").isNotNull())


@query
def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Keys of the texts that the splitter had to cut."""
    pieces = chunking.split_oversized(_configured(spark, folder), table(spark, folder, "config_runs"), True, False)
    return pieces.where("pieza = 1").select("tabla", "clave").distinct()


@query
def p1_trozos(spark: SparkSession, folder: str) -> DataFrame:
    """Every piece of every unit and full text."""
    every = distinct_texts(spark, folder, "uces", "corpus", also=("config_id",))
    return chunking.split_oversized(every, table(spark, folder, "config_runs"))


_WS = r"[^\x09-\x0d\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
ORACLES["p1_found"] = rf"""
with t as (
  select 'uces' as tabla, uce_id as clave, texto, config_id from uces
  union all
  select 'corpus', cast(doc_id as varchar), texto_completo_txt, config_id from corpus
), l as (
  select t.tabla, t.clave, t.texto, coalesce(c.max_tokens_por_uce, (select max_tokens_por_uce from config_runs where config_id = 1)) as limite
  from t left join config_runs c on c.config_id = coalesce(t.config_id, 1)
)
select distinct tabla, clave from l
where clave is not null and len(regexp_extract_all(texto, '{_WS}')) > limite
"""

# --- 2 to 4: terms -------------------------------------------------------------------------------

_COUNTS = """
with u as (select uc_id, any_value(lemmas) as lemmas, any_value(stems) as stems, any_value(bigrams) as bigrams, any_value(cluster_id) as cluster_id
           from ucs where uc_id is not null group by uc_id),
n as (select count(*) as n from u),
v as (
  select uc_id, cluster_id, 'lemmas' as campo, unnest(lemmas) as valor from u
  union all select uc_id, cluster_id, 'stems', unnest(stems) from u
  union all select uc_id, cluster_id, 'bigrams', unnest(bigrams) from u
),
w as (select uc_id, cluster_id, campo, trim(regexp_replace(lower(nfc_normalize(valor)), '(\\pL)σ($|[^\\pL])', '\\1ς\\2', 'g'), ' ' || chr(9)) as termino
      from v where valor is not null),  -- lower() here has no final sigma
tf as (select uc_id, cluster_id, campo, termino, count(*) as tf from w where termino <> '' group by all),
df as (select campo, termino, sum(tf) as apariciones, count(*) as unidades from tf group by all)
"""


@query
def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Terms too rare or too common to be useful."""
    return p2_frecuencias(spark, folder).where("marca is not null").select("campo", "termino", "marca")


@query
def p2_frecuencias(spark: SparkSession, folder: str) -> DataFrame:
    """Occurrences and context units of every distinct lemma, stem and bigram."""
    counts = terms.record_terms(units(spark, folder, "lemmas", "stems", "bigrams"), "uc_id", "lemmas", "stems", "bigrams")
    return terms.term_frequencies(counts, count_units(spark, folder))


_MARCA = """select campo, termino, cast(apariciones as bigint) as apariciones, unidades,
  case when unidades < 3 then 'raro' when 10 * unidades >= 3 * n.n then 'comun' end as marca from df, n"""
ORACLES["p2_frecuencias"] = f"{_COUNTS} {_MARCA}"
ORACLES["p2_found"] = f"{_COUNTS} select campo, termino, marca from ({_MARCA}) where marca is not null"


@query
def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Lemmas that set a unit apart: three times or more in it, in two to twelve units in all."""
    return (
        p3_unidades(spark, folder)
        .where("tf >= 3 and unidades between 2 and 12 and puntaje > 0")
        .select("uc_id", "termino")
    )


@query
def p3_unidades(spark: SparkSession, folder: str) -> DataFrame:
    """Divergence-from-randomness score of every lemma of every context unit."""
    counted = terms.tallies(units(spark, folder, "lemmas"), "uc_id", "lemmas").checkpoint()  # read for the terms and for the records
    counts = counted.select("uc_id", F.lit("lemmas").alias("campo"), F.explode("lemmas").alias("v"), F.col("lemmas_largo").alias("largo")).select("uc_id", "campo", "v.*", "largo")
    scored = terms.divergence_scores(counts, "uc_id", count_units(spark, folder)).drop("campo")
    return scored.withColumn("puntaje", F.round("puntaje", 6))


@query
def p3_clases(spark: SparkSession, folder: str) -> DataFrame:
    """The same score for every lemma of every recorded class; noise and unknown classes left out."""
    of_class = units(spark, folder, "lemmas", "cluster_id").where("cluster_id is not null and cluster_id <> -1")
    values = of_class.select("cluster_id", F.explode("lemmas").alias("valor"))
    counts = (
        values.select("cluster_id", F.lit("lemmas").alias("campo"), terms.term(F.col("valor")).alias("termino"))
        .where("termino is not null and termino <> ''")
        .groupBy("cluster_id", "campo", "termino")
        .agg(F.count(F.lit(1)).alias("tf"))
        .checkpoint()
    )
    lengths = counts.groupBy("cluster_id").agg(F.sum("tf").alias("largo"))
    counts = counts.join(lengths, "cluster_id")
    classes = of_class.select("cluster_id").distinct().count()
    return terms.divergence_scores(counts, "cluster_id", max(classes, 1)).drop("campo").withColumn("puntaje", F.round("puntaje", 6))


ORACLES["p3_found"] = f"""{_COUNTS}
select uc_id, termino from tf join df using (campo, termino) where campo = 'lemmas' and tf >= 3 and unidades between 2 and 12
"""
ORACLES["p3_unidades"] = f"""{_COUNTS},
l as (select uc_id, cast(sum(tf) as double) as largo from tf where campo = 'lemmas' group by uc_id),
m as (select sum(largo) / any_value(n.n) as largo_medio from l, n),
s as (
  select uc_id, termino, tf, cast(apariciones as bigint) as apariciones, unidades, apariciones / cast(n.n as double) as lam,
    tf * log2(1 + largo_medio / largo) as tfn
  from tf join df using (campo, termino) join l using (uc_id), m, n where campo = 'lemmas')
select uc_id, termino, tf, apariciones, unidades, round((log2(1 + lam) + tfn * log2((1 + lam) / lam)) / (tfn + 1), 6) as puntaje from s
"""


ORACLES["p3_clases"] = f"""{_COUNTS},
k as (select cluster_id, termino, sum(tf) as tf from tf where campo = 'lemmas' and cluster_id is not null and cluster_id <> -1 group by all),
nc as (select cast(count(distinct cluster_id) as double) as n from u where cluster_id is not null and cluster_id <> -1),
f as (select termino, sum(tf) as apariciones, count(*) as unidades from k group by termino),
l as (select cluster_id, cast(sum(tf) as double) as largo from k group by cluster_id),
m as (select sum(largo) / any_value(nc.n) as largo_medio from l, nc),
s as (select cluster_id, termino, cast(tf as bigint) as tf, cast(apariciones as bigint) as apariciones, unidades, apariciones / nc.n as lam,
    tf * log2(1 + largo_medio / largo) as tfn from k join f using (termino) join l using (cluster_id), m, nc)
select cluster_id, termino, tf, apariciones, unidades, round((log2(1 + lam) + tfn * log2((1 + lam) / lam)) / (tfn + 1), 6) as puntaje from s
"""


def _baskets(spark: SparkSession, folder: str) -> DataFrame:
    """The distinct lemmas of each context unit."""
    return terms.tallies(units(spark, folder, "lemmas"), "uc_id", "lemmas").select("uc_id", F.col("lemmas.termino").alias("lemmas"))


@query
def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of lemmas that hold the bounds and exceed what the null expects."""
    bounded = cooc.pair_surprise(_baskets(spark, folder), "lemmas", "lemma", count_units(spark, folder), min_pairs=5, per=2000, lift=20)
    return bounded.where("veces > 1").select("lemma_a", "lemma_b")


@query
def p4_pares(spark: SparkSession, folder: str) -> DataFrame:
    """Every two lemmas of a unit with their counts, expectation, tail probability and q value."""
    return cooc.pair_surprise(_baskets(spark, folder), "lemmas", "lemma", count_units(spark, folder))


@query
def p4_conteos(spark: SparkSession, folder: str) -> DataFrame:
    """Every two lemmas of a unit with the units that hold each and both."""
    baskets = _baskets(spark, folder).select("lemmas").checkpoint().where(F.size("lemmas") > 0)
    return cooc.pair_counts(baskets, "lemmas", cooc.item_counts(baskets, "lemmas"), "lemma", 0)


ORACLES["p4_conteos"] = f"""{_COUNTS},
i as (select uc_id, termino from tf where campo = 'lemmas')
select lemma_a, lemma_b, a.unidades as n_a, b.unidades as n_b, n_ab
from (select a.termino as lemma_a, b.termino as lemma_b, count(*) as n_ab from i a join i b on a.uc_id = b.uc_id and a.termino < b.termino group by all) p
join df a on a.campo = 'lemmas' and a.termino = lemma_a join df b on b.campo = 'lemmas' and b.termino = lemma_b
"""
ORACLES["p4_found"] = f"""{_COUNTS},
i as (select distinct uc_id, termino from tf join df using (campo, termino), n
      where campo = 'lemmas' and unidades >= 5 and unidades * 2000 >= n.n and unidades * 20 <= n.n),
p as (select a.termino as lemma_a, b.termino as lemma_b, count(*) as n_ab from i a join i b on a.uc_id = b.uc_id and a.termino < b.termino group by all)
select lemma_a, lemma_b from p
join df a on a.campo = 'lemmas' and a.termino = lemma_a join df b on b.campo = 'lemmas' and b.termino = lemma_b, n
where n_ab >= 5 and 2000 * n_ab >= n.n and n_ab * n.n >= 20 * a.unidades * b.unidades
"""

# --- 5: personal information ---------------------------------------------------------------------


def _finder(spark: SparkSession, folder: str) -> pii.Finder:
    words = pii.learn_words(texts(spark, folder, "corpus", "segmentos", "spans"))
    return pii.train_on(table(spark, folder, "segmentos"), "segmento_id", "texto_literal", words)


@query
def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Kind and start of every mention in full texts, segments and quotes."""
    found = pii.find_mentions(texts(spark, folder, "corpus", "segmentos", "spans"), _finder(spark, folder))
    return found.select("tabla", "clave", "tipo", "inicio").distinct()


@query
def p5_textos(spark: SparkSession, folder: str) -> DataFrame:
    """The same texts with a placeholder for every mention."""
    return pii.replace_mentions(distinct_texts(spark, folder, "corpus", "segmentos", "spans"), _finder(spark, folder))


# --- 6: sentences --------------------------------------------------------------------------------


def _sentence_model(spark: SparkSession, folder: str) -> sentences.Model:
    known = sentences.short_words(texts(spark, folder, "uces", "segmentos"))
    return sentences.train_on(table(spark, folder, "segmentos"), "segmento_id", "texto_literal", known)


@query
def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Where each sentence of the units and segments begins."""
    starts = sentences.sentence_starts(texts(spark, folder, "uces", "segmentos"), _sentence_model(spark, folder))
    return starts.dropDuplicates(["tabla", "clave"]).select("tabla", "clave", F.explode("inicios").alias("inicio"))


@query
def p6_oraciones(spark: SparkSession, folder: str) -> DataFrame:
    """Every sentence of the units and segments, in order."""
    return sentences.split_sentences(distinct_texts(spark, folder, "uces", "segmentos"), _sentence_model(spark, folder))


# --- 7: similarity clusters ----------------------------------------------------------------------


def _clustered(spark: SparkSession, folder: str) -> DataFrame:
    return clusters.cluster(units(spark, folder, "embedding", "cluster_id").checkpoint())


@query
def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Units whose recorded class is null or not the name of their group."""
    return (
        _clustered(spark, folder)
        .where("nombre is not null and (cluster_id is null or cluster_id <> nombre)")
        .select("uc_id", F.col("nombre").alias("cluster_id"))
    )


@query
def p7_grupos(spark: SparkSession, folder: str) -> DataFrame:
    """Each group with its name, size and most typical units."""
    return clusters.describe(_clustered(spark, folder))


@query
def p7_confianza(spark: SparkSession, folder: str) -> DataFrame:
    """How often the recorded class is right, by stability in tenths (null: not known)."""
    members = _clustered(spark, folder).where("nombre is not null")
    stability = units(spark, folder, "stability")
    right = F.coalesce((F.col("cluster_id") == F.col("nombre")).cast("double"), F.lit(0.0))
    return (
        members.join(stability, "uc_id")
        .groupBy(F.floor(F.col("stability") * 10).alias("decimo"))
        .agg(F.count(F.lit(1)).alias("unidades"), F.avg(right).alias("bien_registradas"))
    )


# --- 8 and 9: tokens -----------------------------------------------------------------------------


@query
def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of every document."""
    return bpe.encode(table(spark, folder, "documents"))


@query
def p9_cuotas(spark: SparkSession, folder: str) -> DataFrame:
    """The share that each source really got."""
    return _mix(spark, folder)[1]


@query
def p9_mezcla(spark: SparkSession, folder: str) -> DataFrame:
    """The documents of the mix and how often each is in it."""
    return _mix(spark, folder)[0]


def _mix(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    sized = bpe.count_tokens(table(spark, folder, "documents"), "text", ("doc_id", "source"))
    return mixing.mix(sized, table(spark, folder, "mezcla_objetivo"))


# --- 10: texts that look the same ----------------------------------------------------------------


@query
def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of documents that differ in code points and look the same."""
    return lookalike.look_alike_pairs(lookalike.look_alike_classes(table(spark, folder, "documents")))


@query
def p10_formas(spark: SparkSession, folder: str) -> DataFrame:
    """Every document in its one form, with its look-alike class."""
    documents = table(spark, folder, "documents")
    return lookalike.canonical_texts(documents, lookalike.look_alike_classes(documents))
