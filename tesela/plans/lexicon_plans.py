"""Vocabulary, frequencies, richness, n-grams and networks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesela.functions.stemmer import with_stems
from tesela.operators import lexical, network, terms
from tesela.operators.tables import corpus, unit_terms, units
from tesela.plans.common_sql import CORPUS, MATRIX, UNITS, lower, terms as sql_terms
from tesela.plans.registry import query, rounded


def stems(spark: SparkSession, folder: str, column: str = "stems") -> DataFrame:
    return unit_terms(units(spark, folder, column, "doc_id", "cluster_id"), column, "uce_id", "doc_id", "cluster_id")


def matrix(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(incidence of the stems of the vocabulary, classes of the units); what reads it again finds it written."""
    m, k = matrix_read_once(spark, folder)
    return m.checkpoint(), k


def matrix_read_once(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The same, not written, for what reads it once."""
    t = stems(spark, folder)
    return lexical.incidence(t, "uce_id", lexical.vocabulary(t, "uce_id").select("termino")), units(spark, folder, "cluster_id")


@query("doc_freq_vocabulary", f"with {MATRIX} select termino, unidades, row_number() over (order by termino) - 1 as indice from v")
def doc_freq_vocabulary(spark: SparkSession, folder: str) -> DataFrame:
    return lexical.vocabulary(stems(spark, folder), "uce_id")


@query("incidence_sizes", f"with {MATRIX} select uce_id, count(*) as terminos from m group by uce_id")
def incidence_sizes(spark: SparkSession, folder: str) -> DataFrame:
    return matrix(spark, folder)[0].groupBy("uce_id").agg(F.count(F.lit(1)).alias("terminos"))


@query("class_term_counts", f"with {MATRIX} select cluster_id, termino, count(*) as unidades from m join k using (uce_id) group by all")
def class_term_counts(spark: SparkSession, folder: str) -> DataFrame:
    m, k = matrix(spark, folder)
    return lexical.class_term_counts(m, k.where("cluster_id is not null and cluster_id <> -1"), "uce_id", "cluster_id")


@query(
    "form_index",
    f"""with {UNITS}, z as (select cluster_id, unnest(stems) as raiz, unnest(lemmas) as lema from u where len(stems) = len(lemmas) and cluster_id is not null)
select cluster_id, {lower('trim(raiz)')} as raiz, {lower('trim(lema)')} as lema, count(*) as n from z where raiz is not null and lema is not null group by all""",
)
def form_index(spark: SparkSession, folder: str) -> DataFrame:
    """Lemmas of each stem in each class."""
    u = units(spark, folder, "stems", "lemmas", "cluster_id").where("size(stems) = size(lemmas) and cluster_id is not null")
    z = u.select("cluster_id", F.explode(F.arrays_zip("stems", "lemmas")).alias("z")).select("cluster_id", F.lower(F.trim("z.stems")).alias("raiz"), F.lower(F.trim("z.lemmas")).alias("lema"))
    return z.where("raiz is not null and lema is not null").groupBy("cluster_id", "raiz", "lema").agg(F.count(F.lit(1)).alias("n"))


@query(
    "stem_summary",
    f"""with {UNITS}, z as (select cluster_id, unnest(stems) as raiz, unnest(lemmas) as lema from u where len(stems) = len(lemmas) and cluster_id is not null)
select cluster_id, {lower('trim(raiz)')} as raiz, count(distinct {lower('trim(lema)')}) as lemas, count(*) as n from z where raiz is not null and lema is not null group by all""",
)
def stem_summary(spark: SparkSession, folder: str) -> DataFrame:
    return form_index(spark, folder).groupBy("cluster_id", "raiz").agg(F.count(F.lit(1)).alias("lemas"), F.sum("n").alias("n"))


@query("lemma_stems")
def lemma_stems(spark: SparkSession, folder: str) -> DataFrame:
    """Snowball stem of every distinct lemma."""
    return with_stems(stems(spark, folder, "lemmas").select("termino").distinct())


_CHI2 = """g as (select termino, count(*) as f from m join k using (uce_id) group by termino),
s as (select cluster_id, count(*) as n_clase from k group by cluster_id), n as (select count(*) as n from k),
x as (select termino, cluster_id, count(*) as a from m join k using (uce_id) group by all),
y as (select g.termino, s.cluster_id, cast(f as double) as f, cast(coalesce(a, 0) as double) as a, cast(f - coalesce(a, 0) as double) as b, cast(n_clase - coalesce(a, 0) as double) as c,
        cast(n.n - f - n_clase + coalesce(a, 0) as double) as d, n_clase, cast(n.n as double) as n
      from g, s, n left join x on x.termino = g.termino and x.cluster_id = s.cluster_id),
q as (select *, n * pow(greatest(0, abs(a * d - b * c) - n / 2), 2) / ((a + b) * (c + d) * (a + c) * (b + d)) as chi2 from y where (a + b) * (c + d) * (a + c) * (b + d) > 0)"""
_TERMS = f"""with {MATRIX}, {_CHI2}
select termino, cluster_id, cast(f as bigint) as frecuencia_global, cast(a as bigint) as frecuencia_cluster, round(chi2, 4) as chi2_yates,
  round((case when a / n_clase > f / n then 1 else -1 end) * sqrt(chi2 / n), 4) as phi, round(sqrt(chi2 / n), 4) as cramer_v,
  round(sqrt(chi2 / (chi2 + f)), 4) as c, chi2 > 3.841458820694124 as significativo from q"""


@query("characteristic_terms", _TERMS.replace("* sqrt(chi2 / n), 4) as phi", "* sqrt(chi2 / n), 4) + 0.0 as phi"))
def characteristic_terms(spark: SparkSession, folder: str) -> DataFrame:
    """Chi-square, phi and C of every stem in every recorded class."""
    m, k = matrix(spark, folder)
    return rounded(terms.characteristic_terms(m, k, "uce_id", "cluster_id"), 4)


@query("characteristic_terms_bh")
def characteristic_terms_bh(spark: SparkSession, folder: str) -> DataFrame:
    """The same with p and Benjamini-Hochberg by class."""
    return terms.with_p_values(characteristic_terms(spark, folder), "cluster_id")


@query("permutation_thresholds")
def permutation_thresholds(spark: SparkSession, folder: str) -> DataFrame:
    m, k = matrix_read_once(spark, folder)
    return terms.permutation_thresholds(m, k, "uce_id", "cluster_id", rounds=100)


@query("term_stability")
def term_stability(spark: SparkSession, folder: str) -> DataFrame:
    m, k = matrix_read_once(spark, folder)
    return terms.term_stability(m, k, "uce_id", "cluster_id", rounds=50)


@query(
    "top_terms",
    f"""with w as ({_TERMS}) select * from (select *, row_number() over (partition by cluster_id order by abs(phi) desc, termino) as puesto from w) where puesto <= 10""",
)
def top_terms(spark: SparkSession, folder: str) -> DataFrame:
    return terms.top_terms(characteristic_terms(spark, folder), "cluster_id")


@query(
    "unit_phi",
    f"""with w as ({_TERMS}), {MATRIX},
p as (select uce_id, avg(phi) as phi from m join k using (uce_id) join w using (termino, cluster_id) where significativo and w.phi > 0 group by uce_id)
select uce_id, cluster_id, round(coalesce(phi, 0), 8) as phi from k left join p using (uce_id)""",
)
def unit_phi(spark: SparkSession, folder: str) -> DataFrame:
    m, k = matrix(spark, folder)
    return rounded(terms.unit_phi(m, k, terms.characteristic_terms(m, k, "uce_id", "cluster_id"), "uce_id", "cluster_id", places=8), 8)


_LEMMAS = f"{UNITS}, {sql_terms('lemmas')}"


@query(
    "term_frequency_zipf",
    f"""with {_LEMMAS}, f as (select termino, count(*) as freq_abs, count(distinct uce_id) as n_docs from t group by termino), s as (select sum(freq_abs) as s from f)
select row_number() over (order by freq_abs desc, termino) as rango, termino, freq_abs, round(freq_abs / s, 6) as freq_rel, round(log10(freq_abs / s * 1e6 + 1), 6) as zipf_empirico, n_docs from f, s""",
)
def term_frequency_zipf(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(lexical.zipf_profile(stems(spark, folder, "lemmas"), "uce_id"))


def lexicon(spark: SparkSession, folder: str) -> DataFrame:
    """A frequency lexicon of the corpus itself: lemmas of ten units or more, so that rarer ones are unknown words."""
    t = stems(spark, folder, "lemmas")
    total = t.agg(F.count(F.lit(1))).scalar()
    docs = t.agg(F.countDistinct("uce_id")).scalar()
    counts = t.groupBy("termino").agg(F.count(F.lit(1)).alias("freqcount"), F.countDistinct("uce_id").alias("n")).where("n >= 10").withColumn("t", total).withColumn("d", docs)
    rate = F.col("freqcount") / F.col("t") * 1e6
    return counts.select(F.col("termino").alias("word"), rate.alias("subtlwf"), F.log10(rate + 1).alias("zipf"), (F.col("n") / F.col("d")).alias("cd"), F.col("freqcount").cast("double").alias("freqcount"))


_LEXICON = f"""{_LEMMAS}, o as (select count(*) as o, count(distinct uce_id) as dd from t),
x as (select termino, count(*) as fc, count(distinct uce_id) as n from t group by termino having count(distinct uce_id) >= 10),
l as (select termino, fc / o * 1e6 as subtlwf, log10(fc / o * 1e6 + 1) as zipf, n / dd as cd from x, o),
s as (select t.*, coalesce(subtlwf, 0.01) as subtlwf, coalesce(zipf, 1.0) as zipf, coalesce(cd, 0.001) as cd, zipf is null as is_oov from t left join l using (termino))"""


def scored(spark: SparkSession, folder: str) -> DataFrame:
    return lexical.with_lexicon(stems(spark, folder, "lemmas"), lexicon(spark, folder))


@query(
    "zipf_bands",
    f"""with {_LEXICON}, b as (select case when zipf >= 6 and zipf < 9 then 'B1' when zipf >= 5 and zipf < 6 then 'B2' when zipf >= 4 and zipf < 5 then 'B3' when zipf >= 3 and zipf < 4 then 'B4' when zipf >= 0 and zipf < 3 then 'B5' end as banda, termino from s
  union all select 'B_oov', termino from s where is_oov), c as (select banda, count(*) as n_tokens, count(distinct termino) as n_types from b where banda is not null group by banda)
select banda, n_tokens, n_types, round(n_tokens / o * 100, 6) as pct, case when banda <> 'B_oov' then round(sum(n_tokens / o * 100) over (order by banda), 6) end as pct_acum from c, o""",
)
def zipf_bands(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(lexical.band_profile(scored(spark, folder)))


@query("oov_terms", f"with {_LEXICON} select termino, count(*) as freq_abs, count(distinct uce_id) as n_uces from s where is_oov group by termino")
def oov_terms(spark: SparkSession, folder: str) -> DataFrame:
    return lexical.oov_terms(scored(spark, folder), "uce_id")


@query(
    "lexical_sophistication",
    f"""with {_LEXICON}, z as (select *, -log2(greatest(subtlwf / 1e6, 1e-10)) as sp from s)
select uce_id, round(avg(zipf), 6) as mean_zipf, round(7 - avg(zipf), 6) as sofisticacion, round(avg(is_oov::int), 6) as pct_oov, round(avg((zipf < 3)::int), 6) as pct_bajo,
  round(avg((zipf >= 5 and cd >= 0.5)::int), 6) as oral, round(avg((zipf < 4)::int), 6) as academico, round(avg((zipf < 3 and not is_oov)::int), 6) as dominio,
  round(avg(sp), 6) as sorpresa_media, round(max(sp), 6) as sorpresa_max, round(stddev_pop(sp), 6) as sorpresa_desv from z group by uce_id""",
)
def lexical_sophistication(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(lexical.sophistication(scored(spark, folder), "uce_id"))


@query(
    "register_distribution",
    f"""with {_LEXICON}, r as (select uce_id, avg((zipf >= 5 and cd >= 0.5)::int) as o1, avg((zipf < 4)::int) as a1, avg((zipf < 3 and not is_oov)::int) as d1 from s group by uce_id)
select case when d1 > 0.15 then 'tecnico' when o1 > 0.4 then 'coloquial' when a1 > 0.3 then 'formal' else 'mixto' end as registro, count(*) as n from r group by registro""",
)
def register_distribution(spark: SparkSession, folder: str) -> DataFrame:
    profile = lexical.sophistication(scored(spark, folder), "uce_id")
    return profile.groupBy(lexical.register(F.col("oral"), F.col("academico"), F.col("dominio")).alias("registro")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "lexical_richness",
    f"""with {_LEMMAS}, c as (select doc_id, termino, count(*) as c from t group by all)
select doc_id, cast(sum(c) as bigint) as n_tokens, count(*) as n_types, count(*) filter (c = 1) as hapax, round(count(*) / sum(c), 6) as ttr, round(count(*) / sqrt(sum(c)), 6) as guiraud,
  round(ln(sum(c)) - sum(c * ln(c)) / sum(c), 6) as entropia from c group by doc_id""",
)
def lexical_richness(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(lexical.richness(stems(spark, folder, "lemmas"), "doc_id").drop("d_aprox"))


@query(
    "unit_richness",
    f"""with {_LEMMAS}, c as (select uce_id, termino, count(*) as c, min(i) as p from t group by all)
select uce_id, cast(sum(c) as bigint) as n_tokens, count(*) as n_types, count(*) filter (c = 1) as hapax, count(*) filter (p < 35) as d_aprox, round(count(*) / sum(c), 6) as ttr,
  round(count(*) / sqrt(sum(c)), 6) as guiraud, round(abs(ln(sum(c)) - sum(c * ln(c)) / sum(c)), 6) as entropia from c group by uce_id""",
)
def unit_richness(spark: SparkSession, folder: str) -> DataFrame:
    got = lexical.richness(stems(spark, folder, "lemmas"), "uce_id")
    return rounded(got.withColumn("entropia", F.abs("entropia")))


@query("mtld_units")
def mtld_units(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(units(spark, folder, "lemmas").where("lemmas is not null").select("uce_id", lexical.mtld(F.filter("lemmas", lambda w: w.isNotNull())).alias("mtld")))


@query(
    "richness_by_sex",
    f"""with {_LEMMAS}, c as (select doc_id, termino, count(*) as c from t group by all), r as (select doc_id, count(*) / sum(c) as ttr from c group by doc_id), {CORPUS}
select meta['Sexo'] as sexo, count(*) as n, round(avg(ttr), 4) as ttr_media, round(stddev_samp(ttr), 4) as ttr_desv from r join d using (doc_id) where meta['Sexo'] is not null group by sexo""",
)
def richness_by_sex(spark: SparkSession, folder: str) -> DataFrame:
    got = lexical.richness(stems(spark, folder, "lemmas"), "doc_id").join(corpus(spark, folder, "meta"), "doc_id")
    return lexical.summary_by(got.withColumn("sexo", F.col("meta")["Sexo"]), "sexo", "ttr")


@query(
    "distinctive_by_class",
    f"""with {_LEMMAS}, c as (select cluster_id, termino, count(*) as f_grupo from t where cluster_id is not null group by all), f as (select termino, sum(f_grupo) as f_total from c group by termino),
g as (select cluster_id, sum(f_grupo) as n_grupo from c group by cluster_id), s as (select sum(f_grupo) as s from c),
z as (select cluster_id, termino, f_grupo, cast(f_total as bigint) as f_total, round(f_grupo / n_grupo * (ln((s + 1) / (f_total + 1)) + 1), 9) as puntaje from c join f using (termino) join g using (cluster_id), s)
select cluster_id, puesto, termino, f_grupo, f_total, round(puntaje, 6) as puntaje from (select *, row_number() over (partition by cluster_id order by puntaje desc, termino) as puesto from z) where puesto <= 10""",
)
def distinctive_by_class(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(lexical.distinctive(stems(spark, folder, "lemmas"), "cluster_id"))


@query(
    "adjacent_bigrams",
    f"""with {_LEMMAS}, b as (select uce_id, i, termino || '_' || lead(termino) over (partition by uce_id order by i) as ngrama from t) select ngrama, count(*) as n from b where ngrama is not null group by ngrama""",
)
def adjacent_bigrams(spark: SparkSession, folder: str) -> DataFrame:
    return lexical.adjacent_ngrams(stems(spark, folder, "lemmas"), "uce_id").groupBy("ngrama").agg(F.count(F.lit(1)).alias("n"))


#: Word classes of the bigrams and trigrams that are kept.
BIGRAMS = [("NOUN", "NOUN"), ("ADJ", "NOUN"), ("NOUN", "ADJ")]
TRIGRAMS = [("ADV", "ADJ", "NOUN"), ("ADV", "VERB", "NOUN")]


@query(
    "pattern_bigrams",
    f"""with {UNITS}, z as (select uce_id, unnest(lemmas) as l, unnest(pos_tags) as p, generate_subscripts(lemmas, 1) as i from u where len(lemmas) = len(pos_tags)),
w as (select uce_id, i, {lower("trim(l, ' ' || chr(9))")} as termino, p from z), x as (select * from w where termino <> ''),
y as (select uce_id, termino, lead(termino) over (partition by uce_id order by i) as t2, p || ' ' || lead(p) over (partition by uce_id order by i) as pp from x)
select termino || '_' || t2 as ngrama, count(*) as n from y where pp in ('NOUN NOUN', 'ADJ NOUN', 'NOUN ADJ') group by ngrama""",
)
def pattern_bigrams(spark: SparkSession, folder: str) -> DataFrame:
    """Neighbouring lemmas of the kept word classes."""
    u = units(spark, folder, "lemmas", "pos_tags").where("size(lemmas) = size(pos_tags)")
    z = u.select("uce_id", F.posexplode(F.arrays_zip("lemmas", "pos_tags")).alias("i", "z"))
    t = z.select("uce_id", "i", F.lower(F.btrim(F.col("z.lemmas"), F.lit(" \t"))).alias("termino"), F.col("z.pos_tags").alias("pos")).where("termino is not null and termino <> ''")
    return lexical.adjacent_ngrams(t, "uce_id", 2, patterns=BIGRAMS).groupBy("ngrama").agg(F.count(F.lit(1)).alias("n"))


_WINDOW = f"""{_LEMMAS}, r as (select uce_id, termino, row_number() over (partition by uce_id order by i) as k from t),
w as (select least(a.termino, b.termino) as a, greatest(a.termino, b.termino) as b, count(*) * 2 as conteo from r a join r b on a.uce_id = b.uce_id and b.k - a.k between 1 and 4 group by all)"""


@query("cooc_window4", f"with {_WINDOW} select * from w")
def cooc_window4(spark: SparkSession, folder: str) -> DataFrame:
    return network.window_counts(stems(spark, folder, "lemmas"), "uce_id")


@query(
    "semantic_network",
    f"""with {_WINDOW}, e as (select * from w where conteo >= 10 and a <> b), s as (select distinct termino, doc_id from t),
x as (select e.a, e.b, count(*) as shared_docs from e join s p on p.termino = e.a join s q on q.termino = e.b and q.doc_id = p.doc_id group by all)
select a, b, conteo, coalesce(shared_docs, 0) as shared_docs, conteo * coalesce(shared_docs, 0) as peso from e left join x using (a, b)""",
)
def semantic_network(spark: SparkSession, folder: str) -> DataFrame:
    t = stems(spark, folder, "lemmas")
    edges = network.window_counts(t, "uce_id").where("conteo >= 10 and a <> b")
    return network.shared_documents(edges, t, "doc_id")


_PAIRS = f"""{MATRIX}, nn as (select count(*) as n from u), e as (select a.termino as a, b.termino as b, count(*) as conteo from m a join m b on a.uce_id = b.uce_id and a.termino < b.termino group by all having count(*) >= 5)"""


@query("cooc_binary", f"with {_PAIRS} select * from e")
def cooc_binary(spark: SparkSession, folder: str) -> DataFrame:
    return network.pair_counts(matrix(spark, folder)[0], "uce_id", least=5)


@query(
    "cooc_weights",
    f"""with {_PAIRS}, z as (select e.*, cast(p.unidades as double) as fa, cast(q.unidades as double) as fb, cast(nn.n as double) as n from e join v p on p.termino = e.a join v q on q.termino = e.b, nn),
y as (select *, ln(((conteo + 1) / n) / (((fa + 1) / n) * ((fb + 1) / n))) as lg from z)
select a, b, conteo, fa, fb, round(lg / ln(2.0), 6) as pmi, round(greatest(lg / ln(2.0), 0), 6) as ppmi, round(lg / -ln((conteo + 1) / n), 6) as npmi from y""",
)
def cooc_weights(spark: SparkSession, folder: str) -> DataFrame:
    t = stems(spark, folder)
    v = lexical.vocabulary(t, "uce_id").checkpoint()
    edges = network.pair_counts(lexical.incidence(t, "uce_id", v).checkpoint(), "uce_id", least=5)
    return rounded(network.association(edges, v, units(spark, folder).count()))


def _edges(spark: SparkSession, folder: str, frequent: bool = False) -> DataFrame:
    """The network: pairs of stems in two units or more, weighted by ppmi.

    ``frequent``, as the SQL of network_degree has it: in twenty units or more and in one of two hundred.
    """
    t = stems(spark, folder)
    n = units(spark, folder).count()
    least = max(20, n // 200) if frequent else 2
    v = lexical.vocabulary(t, "uce_id", min_units=least).checkpoint()
    pairs = network.pair_counts(lexical.incidence(t, "uce_id", v), "uce_id", least=least)
    return network.association(pairs, v, n).where("ppmi > 0").select("a", "b", "conteo", "ppmi")


_NETWORK = f"""{UNITS}, {sql_terms('stems')}, nn as (select count(*) as n, greatest(20, count(*) // 200) as lim from u),
v as (select termino, count(distinct uce_id) as unidades from t group by termino having count(distinct uce_id) >= (select lim from nn)),
m as (select distinct uce_id, termino from t join v using (termino)),
e as (select a.termino as a, b.termino as b, count(*) as conteo from m a join m b on a.uce_id = b.uce_id and a.termino < b.termino group by all having count(*) >= (select lim from nn)),
g as (select e.*, ln(((conteo + 1) / n) / (((p.unidades + 1) / n) * ((q.unidades + 1) / n))) / ln(2.0) as ppmi from e join v p on p.termino = e.a join v q on q.termino = e.b, nn)"""


@query(
    "network_degree",
    f"""with {_NETWORK}, x as (select a as nodo, ppmi from g where ppmi > 0 union all select b, ppmi from g where ppmi > 0)
select nodo, count(*) as grado, round(sum(ppmi), 6) as grado_peso from x group by nodo""",
)
def network_degree(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(network.degrees(_edges(spark, folder, frequent=True), "ppmi"))


@query("network_pagerank")
def network_pagerank(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(network.pagerank(_edges(spark, folder), "ppmi"), 9)


@query("network_communities")
def network_communities(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(network.communities_of_any_size(_edges(spark, folder), "ppmi"), 9)


@query("community_summary")
def community_summary(spark: SparkSession, folder: str) -> DataFrame:
    edges = _edges(spark, folder).checkpoint()
    frequency = lexical.vocabulary(stems(spark, folder), "uce_id")
    return rounded(network.community_summary(network.communities_of_any_size(edges, "ppmi"), edges, "ppmi", frequency))
