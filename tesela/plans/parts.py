"""Queries of single operators: text forms, places, segments, mentions, frames, stored collections."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesela.functions import text as T
from tesela.functions.vectors import usable
from tesela.operators import agents, classify, coref, grammar, lexical, network, segmentation, space, terms, unit_grammar
from tesela.operators.tables import context_units, corpus, table, unique, units
from tesela.plans.common_sql import CONTEXT_UNITS, CORPUS, MATRIX, UNITS, lower
from tesela.plans.grammar_plans import _NEGATIONS, _PARSED, _TAGGED, _VERBS, parsed, spoken
from tesela.plans.lexicon_plans import _LEMMAS, _LEXICON, _TERMS, lexicon, matrix, stems
from tesela.plans.registry import query, rounded
from tesela.plans.space_plans import _VECTORS, DIM, _embedded, class_centroids
from tesela.session import ensure_checkpoint_dir
from tesela.sources import readers, sinks

SPANS = "s as (select distinct on (span_id) * from spans where span_id is not null)"


def spans(spark: SparkSession, folder: str) -> DataFrame:
    return unique(table(spark, folder, "spans"), "span_id")


def store(spark: SparkSession) -> str:
    """A folder of its own for stored collections, in the session's shared folder."""
    return f"{ensure_checkpoint_dir(spark)}/coleccion-{uuid.uuid4().hex}"


# --- text forms ----------------------------------------------------------------------------------

_UUID = "123e4567-e89b-12d3-a456-426614174000"


@query(
    "unit_ids",
    f"""with {UNITS} select uce_id, case when doc_id % 3 = 0 or doc_id % 2 = 0 then concat_ws('_', doc_id, section_id, local_idx) else uce_id end as id from u where doc_id is not null""",
)
def unit_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Ids made where a unit has none or a UUID."""
    u = units(spark, folder, "doc_id", "section_id", "local_idx").where("doc_id is not null")
    given = F.when(F.col("doc_id") % 3 == 0, _UUID).when(F.col("doc_id") % 2 == 0, F.lit(None).cast("string")).otherwise(F.col("uce_id"))
    place = (F.col(c).cast("string") for c in ("doc_id", "section_id", "local_idx"))
    return u.select("uce_id", readers.unit_id(given, *place).alias("id"))


@query(
    "term_streams",
    f"""with {UNITS}, x as (select unnest(list_concat(coalesce(stems, []), coalesce(bigram_stems, []), coalesce(trigram_stems, []))) as termino from u)
select termino, count(*) as n from x where termino is not null and termino <> '' group by termino""",
)
def term_streams(spark: SparkSession, folder: str) -> DataFrame:
    """Occurrences of stems, bigrams and trigrams in one stream."""
    u = units(spark, folder, "stems", "bigram_stems", "trigram_stems")
    return segmentation.term_stream(u, "uce_id", "stems", "bigram_stems", "trigram_stems").groupBy("termino").agg(F.count(F.lit(1)).alias("n"))


def _kept(stop: list[str], more: str = "") -> str:
    words = ", ".join(f"'{w}'" for w in stop)
    return f"array_to_string(list_filter(regexp_split_to_array(trim({lower('quote')}), '\\s+'), lambda x: x not in ({words}){more}), ' ')"


@query(
    "representatives",
    f"with {SPANS} select span_id, {_kept(T.REPRESENTATIVE_STOP)} as corto, {_kept(T.REPRESENTATIVE_STOP_LONG, ' and length(x) > 2')} as largo from s where quote is not null",
)
def representatives(spark: SparkSession, folder: str) -> DataFrame:
    """Quotes as representatives of an entity, by both rules."""
    q = spans(spark, folder).where("quote is not null")
    return q.select("span_id", T.representative(F.col("quote")).alias("corto"), T.representative(F.col("quote"), True).alias("largo"))


@query("clean_quotes", rf"""with {SPANS} select span_id, regexp_replace(regexp_replace(quote, '^[\s"''“”«»‘’]*(?:\.\.\.|…)?[\s"''“”«»‘’]*', ''), '[\s"''“”«»‘’]*(?:\.\.\.|…)?[\s"''“”«»‘’]*$', '') as quote from s where quote is not null""")
def clean_quotes(spark: SparkSession, folder: str) -> DataFrame:
    return spans(spark, folder).where("quote is not null").select("span_id", T.clean_quote(F.col("quote")).alias("quote"))


@query(
    "tail_contexts",
    f"""with {CORPUS}, t as (select doc_id, right(texto_completo_txt, 500) as t from d where texto_completo_txt is not null)
select doc_id, case when length(t) > 300 and instr(t, '.') > 0 then substring(t, instr(t, '.') + 1, 500) else t end as cola from t""",
)
def tail_contexts(spark: SparkSession, folder: str) -> DataFrame:
    """What is carried on of each interview: its tail from a sentence on."""
    return corpus(spark, folder, "texto_completo_txt").where("texto_completo_txt is not null").select("doc_id", T.tail_context(F.col("texto_completo_txt")).alias("cola"))


_CLITIC = " ".join(f"when ends_with(termino, '{c}') and length(termino) >= {len(c) + 2} then '{c}'" for c in T.CLITICS)


@query(
    "enclitic_forms",
    f"""with {_LEMMAS}, w as (select distinct termino from t), c as (select termino, case {_CLITIC} end as clitico from w)
select termino, substring(termino, 1, length(termino) - length(clitico)) as base, clitico, case termino when 'al' then 'a+el' when 'del' then 'de+el' else termino end as partes from c""",
)
def enclitic_forms(spark: SparkSession, folder: str) -> DataFrame:
    """Base and enclitic of every lemma that may have one, and the words of a contraction."""
    w = stems(spark, folder, "lemmas").select("termino").distinct().withColumn("e", T.enclitic(F.col("termino")))
    return w.select("termino", F.col("e.base").alias("base"), F.col("e.clitico").alias("clitico"), F.array_join(T.expand_contraction(F.col("termino")), "+").alias("partes"))


# --- units, segments and boundaries ----------------------------------------------------------------


@query("recovered_units", f"with {UNITS} select doc_id, uce_id, row_number() over (partition by doc_id order by coalesce(local_idx, 0), uce_id) as lugar from u where is_stable and doc_id is not null")
def recovered_units(spark: SparkSession, folder: str) -> DataFrame:
    """Stable units with their place in the order of their document."""
    u = readers.stable_units(units(spark, folder, "doc_id", "local_idx", "is_stable").where("doc_id is not null"))
    return lexical.with_rank(u.withColumn("_o", F.coalesce("local_idx", F.lit(0))), [F.col("_o"), F.col("uce_id")], "lugar", by="doc_id").select("doc_id", "uce_id", F.col("lugar").cast("long").alias("lugar"))


@query(
    "assembled_units",
    f"""with recursive {UNITS}, o as (select doc_id, uce_id, coalesce(len(lemmas), 0) as n, row_number() over (partition by doc_id order by local_idx, uce_id) as k from u where doc_id is not null and local_idx is not null),
r as (select doc_id, uce_id, k, 0 as uc, n as t, n from o where k = 1
  union all select o.doc_id, o.uce_id, o.k, case when r.t >= 10 then r.uc + 1 else r.uc end, case when r.t >= 10 then o.n else r.t + o.n end, o.n from r join o on o.doc_id = r.doc_id and o.k = r.k + 1)
select 'uc_' || doc_id || '_' || uc as uc_id, doc_id, uc as uc_idx, list(uce_id order by k) as uce_ids, cast(sum(n) as int) as formas from r group by doc_id, uc""",
)
def assembled_units(spark: SparkSession, folder: str) -> DataFrame:
    """Context units put together from their elementary units."""
    u = units(spark, folder, "doc_id", "local_idx", "lemmas").where("doc_id is not null and local_idx is not null")
    u = u.withColumn("orden", F.concat(F.lpad(F.col("local_idx").cast("string"), 10, "0"), F.lit("/"), "uce_id")).withColumn("n", F.greatest(F.size("lemmas"), F.lit(0)))
    u = u.withColumn("lemmas", F.coalesce("lemmas", F.array().cast("array<string>")))
    got = segmentation.assembled(segmentation.context_units(u, "doc_id", "orden", "n"), "doc_id", "orden", None, "lemmas")
    return got.select("uc_id", "doc_id", "uc_idx", "uce_ids", F.size("lemmas").alias("formas"))


_ORDERED = f"{CONTEXT_UNITS}, o as (select uc_id, doc_id, cluster_id, lemmas, stems, embedding, cast(string_split(uc_id, '_')[-1] as int) as orden from c)"


@query(
    "progressive_segments",
    f"""with {_ORDERED}, m as (select *, lag(orden) over w is not null and cluster_id is distinct from lag(cluster_id) over w as cambia from o window w as (partition by doc_id order by orden))
select uc_id, cast(sum(cambia::int) over (partition by doc_id order by orden rows between unbounded preceding and current row) as int) as segmento from m""",
)
def progressive_segments(spark: SparkSession, folder: str) -> DataFrame:
    """Context units in segments that end where the class changes."""
    moved = space.trajectory(_embedded(spark, folder).drop("embedding"), "doc_id", "orden", "cluster_id")
    return segmentation.progressive(moved.withColumn("cambio_de_tema", F.col("cambio") > 0), "doc_id", "orden").select("uc_id", "segmento")


_RICH = f"""{_ORDERED}, e as (select uc_id, doc_id, orden, embedding::double[] as v, list_filter(coalesce(lemmas, []), lambda x: x is not null) as l, len(coalesce(lemmas, [])) as nl, len(coalesce(stems, [])) as ns from o
  where len(embedding) = 32 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
n as (select *, lag(v) over w as v0, lag(l) over w as l0, lag(nl) over w as nl0, lag(ns) over w as ns0 from e window w as (partition by doc_id order by orden))"""


def _rich(spark: SparkSession, folder: str) -> DataFrame:
    place = F.expr("try_cast(element_at(split(uc_id, '_'), -1) as int)")
    u = context_units(spark, folder, "doc_id", "embedding", "lemmas", "stems").withColumn("orden", place).where(usable("embedding", DIM))
    size = lambda c: F.greatest(F.size(c), F.lit(0))
    return u.select("uc_id", "doc_id", "orden", "embedding", F.filter(F.coalesce("lemmas", F.array().cast("array<string>")), lambda x: x.isNotNull()).alias("l"), size("lemmas").alias("nl"), size("stems").alias("ns"))


@query(
    "entity_boundaries",
    f"""with {_RICH} select uc_id, round(case when nl < 4 then -1.0 else 0.5 * (1 - list_cosine_similarity(v, v0)) + 0.5 * (1 - case when len(list_distinct(list_concat(coalesce(l0, []), l))) > 0
  then len(list_intersect(coalesce(l0, []), l)) / len(list_distinct(list_concat(coalesce(l0, []), l))) else 0 end) end, 6) as puntaje from n""",
)
def entity_boundaries(spark: SparkSession, folder: str) -> DataFrame:
    """Strength of the boundary before each context unit: unlikeness and unshared lemmas."""
    return rounded(segmentation.entity_boundary(_rich(spark, folder), "doc_id", "orden", "embedding", "l", "nl").select("uc_id", "puntaje"))


@query(
    "topic_changes",
    f"""with {_RICH} select uc_id, coalesce((list_cosine_similarity(v, v0) < 0.6 or case when sqrt((nl * nl + ns * ns) * (nl0 * nl0 + ns0 * ns0)) > 0
  then 1 - (nl * nl0 + ns * ns0) / sqrt((nl * nl + ns * ns) * (nl0 * nl0 + ns0 * ns0)) when nl0 is not null then 1 end > 0.4) and nl >= 4 and nl0 >= 4, false) as cambio_de_tema from n""",
)
def topic_changes(spark: SparkSession, folder: str) -> DataFrame:
    """Where a context unit of substance turns away from the one before."""
    u = _rich(spark, folder).withColumn("perfil", F.create_map(F.lit("lemas"), F.col("nl").cast("double"), F.lit("raices"), F.col("ns").cast("double")))
    return segmentation.shifts(u.withColumn("sustancia", F.col("nl") >= 4), "doc_id", "orden", "embedding", "perfil", "sustancia").select("uc_id", "cambio_de_tema")


# --- places, mentions and chains -------------------------------------------------------------------

_PLACED = f"""{UNITS}, sg as (select distinct on (segmento_id) * from segmentos where segmento_id is not null),
j as (select segmento_id, doc_id, idx, coalesce(sum(coalesce(length(texto_literal), 0) + 2) over (partition by doc_id order by idx rows between unbounded preceding and 1 preceding), 0) as s0, coalesce(length(texto_literal), 0) as sn from sg),
pu as (select u.uce_id, u.doc_id, cast(j.s0 + u.start_char as bigint) as a, cast(j.s0 + u.start_char + coalesce(length(u.texto), 0) as bigint) as z from u join j using (segmento_id) where u.start_char is not null and u.doc_id is not null),
{SPANS}, mn as (select s.span_id, pu.doc_id, s.agent as chain_id, s.quote as representative, pu.a + s.start_char as a, pu.a + s.end_char as z from s join pu using (uce_id) where s.start_char >= 0)"""


def segment_places(spark: SparkSession, folder: str) -> DataFrame:
    segments = unique(table(spark, folder, "segmentos").select("segmento_id", "doc_id", "idx", "texto_literal"), "segmento_id")
    return segmentation.interval_starts(segments, "doc_id", "idx", "texto_literal")


def placed_units(spark: SparkSession, folder: str) -> DataFrame:
    """Units with their first and last place in the interview."""
    starts = segment_places(spark, folder).select("segmento_id", "s_start")
    u = units(spark, folder, "doc_id", "segmento_id", "start_char", "texto").where("start_char is not null and doc_id is not null").join(starts, "segmento_id")
    begin = (F.col("s_start") + F.col("start_char")).cast("long")
    return u.select("uce_id", "doc_id", begin.alias("start_char"), (begin + F.coalesce(F.length("texto"), F.lit(0))).alias("end_char"))


def mentions(spark: SparkSession, folder: str) -> DataFrame:
    """Located annotations as mentions: the agent is the chain, places are those in the interview."""
    u = placed_units(spark, folder).select("uce_id", "doc_id", F.col("start_char").alias("u0"))
    s = spans(spark, folder).where("start_char >= 0").select("span_id", "uce_id", F.col("agent").alias("chain_id"), F.col("quote").alias("representative"), "start_char", "end_char")
    return segmentation.global_offsets(s.join(u, "uce_id"), "u0", "start_char", "end_char").drop("u0", "uce_id")


@query("global_spans", f"with {_PLACED} select span_id, doc_id, a as start_char, z as end_char from mn")
def global_spans(spark: SparkSession, folder: str) -> DataFrame:
    return mentions(spark, folder).select("span_id", "doc_id", "start_char", "end_char")


@query("mentions_by_unit", f"with {_PLACED} select mn.span_id, pu.uce_id from mn join pu on pu.doc_id = mn.doc_id and mn.a >= pu.a and mn.a < pu.z")
def mentions_by_unit(spark: SparkSession, folder: str) -> DataFrame:
    """Units in which each mention begins."""
    return coref.mentions_in_units(mentions(spark, folder), placed_units(spark, folder)).select("span_id", "uce_id")


@query(
    "chain_coverage",
    f"""with {_PLACED}, x as (select distinct pu.doc_id, pu.uce_id, chain_id from mn join pu on pu.doc_id = mn.doc_id and mn.a >= pu.a and mn.a < pu.z), y as (select doc_id, count(distinct chain_id) as n_cadenas, count(distinct uce_id) as con from x group by doc_id)
select doc_id, coalesce(n_cadenas, 0) as n_cadenas, round(coalesce(con, 0) / n, 6) as cobertura from (select doc_id, count(*) as n from pu group by doc_id) left join y using (doc_id)""",
)
def chain_coverage(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(coref.coverage(mentions(spark, folder), placed_units(spark, folder)))


@query("distinct_mentions", f"with {_PLACED} select doc_id, count(distinct (a, z)) as menciones from mn group by doc_id")
def distinct_mentions(spark: SparkSession, folder: str) -> DataFrame:
    return coref.unique_mentions(mentions(spark, folder)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("menciones"))


@query(
    "bridged_segments",
    f"""with {_PLACED}, x as (select distinct j.doc_id, chain_id, j.idx from mn join j on j.doc_id = mn.doc_id and mn.a >= j.s0 and mn.a < j.s0 + j.sn where chain_id is not null)
select distinct p.doc_id, p.idx as segmento from x p join x q on q.doc_id = p.doc_id and q.chain_id = p.chain_id and q.idx = p.idx + 1""",
)
def bridged_segments(spark: SparkSession, folder: str) -> DataFrame:
    """Segments that share a chain with the next."""
    segments = segment_places(spark, folder).select("doc_id", F.col("idx").alias("segmento"), "s_start", "s_end")
    return coref.bridged_segments(mentions(spark, folder), segments)


@query("entities_over_documents", f"with {_PLACED}, x as (select doc_id, lower(trim(chain_id)) as entidad, count(*) as n from mn group by all) select entidad, count(distinct doc_id) as n_docs, cast(sum(n) as bigint) as menciones from x group by entidad")
def entities_over_documents(spark: SparkSession, folder: str) -> DataFrame:
    chains = mentions(spark, folder).groupBy("doc_id", F.col("chain_id").alias("representative")).agg(F.count(F.lit(1)).alias("n"))
    return coref.cross_document(chains, "representative", "doc_id", "n")


@query(
    "marked_units",
    f"""with {UNITS}, {SPANS}, f as (select uce_id, arg_min({{'a': start_char, 'z': end_char, 'k': trait}}, (start_char, end_char, span_id)) as x from s where start_char >= 0 and end_char >= start_char and trait is not null group by uce_id)
select uce_id, case when x is null then texto else substring(texto, 1, x.a) || '<span class="' || x.k || '">' || substring(texto, x.a + 1, x.z - x.a) || '</span>' || substring(texto, x.z + 1) end as html from u left join f using (uce_id) where texto is not null""",
)
def marked_units(spark: SparkSession, folder: str) -> DataFrame:
    """Units with the first annotation of each marked."""
    s = spans(spark, folder).where("start_char >= 0 and end_char >= start_char and trait is not null")
    first = s.groupBy("uce_id").agg(F.min_by(F.struct(F.col("start_char").alias("inicio"), F.col("end_char").alias("fin"), F.col("trait").alias("clase")), F.struct("start_char", "end_char", "span_id")).alias("x"))
    return grammar.marked_html(units(spark, folder, "texto").where("texto is not null"), first.select("uce_id", "x.*"), "uce_id", "texto")


@query("annotations_read", f"with {SPANS} select agent, confidence, count(*) as n from s where agent in ('emocion', 'ideologia') group by all")
def annotations_read(spark: SparkSession, folder: str) -> DataFrame:
    """Annotations that an agent reads which waits for two others."""
    read = agents.previous_annotations(spans(spark, folder), {"name": "sintesis", "disc_cats": ["emocion", "ideologia"]})
    return read.groupBy("agent", "confidence").agg(F.count(F.lit(1)).alias("n"))


# --- frames ----------------------------------------------------------------------------------------

_FRAMES = f"""{UNITS}, {SPANS}, f as (select s.span_id as frame_idx, s.doc_id, s.uce_id, s.agent as cadena, s.trait as verb_lemma, s.confidence as object_lemma, case s.span_id % 3 when 0 then 'AGENT' when 1 then 'PATIENT' else 'OBLIQUE' end as role,
  case when s.span_id % 2 = 0 then 'Act' else 'Pass' end as voice, s.span_id % 5 = 0 as negated, u.cluster_id, s.start_char, s.end_char from s join u using (uce_id))"""


def frames(spark: SparkSession, folder: str) -> DataFrame:
    """Annotations as frames: the agent is the chain, trait and confidence stand for verb and object."""
    s = spans(spark, folder).join(units(spark, folder, "cluster_id"), "uce_id")
    role = F.when(F.col("span_id") % 3 == 0, "AGENT").when(F.col("span_id") % 3 == 1, "PATIENT").otherwise("OBLIQUE")
    return s.select(
        F.col("span_id").alias("frame_idx"), "doc_id", "uce_id", F.col("agent").alias("cadena"), F.col("trait").alias("verb_lemma"), F.col("confidence").alias("object_lemma"), role.alias("role"),
        F.when(F.col("span_id") % 2 == 0, "Act").otherwise("Pass").alias("voice"), (F.col("span_id") % 5 == 0).alias("negated"), "cluster_id", F.lit(False).alias("is_expansion"), "start_char", "end_char",
    )


@query(
    "chain_frames",
    f"""with {_FRAMES}, k as (select cadena, cluster_id, count(*) as n from f where cadena is not null and cluster_id is not null group by all), k1 as (select cadena, arg_min(cluster_id, (-n, cluster_id)) as clase from k group by cadena),
r as (select cadena, role, count(*) as n from f where cadena is not null group by all), r1 as (select cadena, arg_min(role, (-n, role)) as rol from r group by cadena)
select cadena, count(*) as n_frames, any_value(clase) as clase, any_value(rol) as rol, round(avg((role = 'AGENT')::int), 6) as agente, round(avg((role = 'PATIENT')::int), 6) as paciente,
  list_sort(list(distinct verb_lemma) filter (verb_lemma is not null))[1:8] as verbos, list_sort(list(distinct object_lemma) filter (object_lemma is not null))[1:8] as objetos, count(distinct uce_id) as n_uces, 0::bigint as n_expansiones
from f left join k1 using (cadena) left join r1 using (cadena) where cadena is not null group by cadena""",
)
def chain_frames(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(coref.chain_summary(frames(spark, folder), "cadena", "cluster_id"))


@query(
    "cluster_frames",
    f"""with {_FRAMES}, v as (select cluster_id, verb_lemma as x, count(*) as n from f where verb_lemma is not null group by all), v1 as (select cluster_id, list(x order by n desc, x)[1:5] as top_verb_lemma from v group by cluster_id)
select cluster_id, count(*) as n_frames, count(*) filter (negated) as n_negados, any_value(top_verb_lemma) as top_verb_lemma, count(*) filter (role = 'AGENT') as agentes, count(*) filter (voice = 'Pass') as pasivas from f left join v1 using (cluster_id) where cluster_id is not null group by cluster_id""",
)
def cluster_frames(spark: SparkSession, folder: str) -> DataFrame:
    got = coref.cluster_summary(frames(spark, folder).where("cluster_id is not null"), "cluster_id")
    return got.select("cluster_id", "n_frames", "n_negados", "top_verb_lemma", F.coalesce(F.col("por_role")["AGENT"], F.lit(0)).alias("agentes"), F.coalesce(F.col("por_voice")["Pass"], F.lit(0)).alias("pasivas"))


@query(
    "frame_edges",
    f"""with {_FRAMES}, l as (select frame_idx::varchar as b, lag(frame_idx::varchar) over (partition by cadena order by frame_idx) as a, 2.0 as peso from f where cadena is not null
  union all select frame_idx::varchar, lag(frame_idx::varchar) over (partition by doc_id, cadena order by frame_idx), 1.0 from f where cadena is not null)
select least(a, b) as a, greatest(a, b) as b, cast(max(peso) as double) as peso from l where a is not null group by 1, 2""",
)
def frame_edges(spark: SparkSession, folder: str) -> DataFrame:
    return coref.frame_graph(frames(spark, folder), "frame_idx", "doc_id", "cadena")


@query(
    "frames_in_ranges",
    f"""with {_FRAMES}, r as (select doc_id, min(start_char) + 20 as lo, min(start_char) + 200 as hi from f where start_char >= 0 group by doc_id)
select frame_idx, lo from f join r using (doc_id) where start_char >= 0 and start_char < hi and end_char > lo""",
)
def frames_in_ranges(spark: SparkSession, folder: str) -> DataFrame:
    """Frames that overlap a range of their document."""
    f = frames(spark, folder).where("start_char >= 0")
    ranges = f.groupBy("doc_id").agg((F.min("start_char") + 20).alias("lo"), (F.min("start_char") + 200).alias("hi"))
    placed = f.select("frame_idx", "doc_id", *(F.col(c).alias(f"{p}_{s}") for p in ("entity", "verb", "object") for c, s in (("start_char", "start"), ("end_char", "end"))))
    return coref.frames_in_range(placed, ranges).select("frame_idx", "lo")


@query(
    "frames_with_classes",
    f"with {_FRAMES} select frame_idx, case when frame_idx % 2 = 0 then 99 else cluster_id end as cluster_id from f",
)
def frames_with_classes(spark: SparkSession, folder: str) -> DataFrame:
    """Classes written back to half of the frames by key."""
    f = frames(spark, folder).select("doc_id", "uce_id", "frame_idx", "cluster_id")
    new = f.where("frame_idx % 2 = 0").select("doc_id", "uce_id", "frame_idx").withColumn("cluster_id", F.lit(99))
    return coref.with_clusters(f, new).select("frame_idx", "cluster_id")


@query(
    "expanded_frames",
    f"with {_FRAMES} select role, is_expansion, count(*) as n from (select role, false as is_expansion from f union all select role, true from f where verb_lemma = 'agencia' union all select role, true from f where verb_lemma = 'agencia') group by all",
)
def expanded_frames(spark: SparkSession, folder: str) -> DataFrame:
    """Frames with two related nouns in the place of one entity."""
    f = frames(spark, folder).drop("is_expansion").withColumn("entity_lemma", F.col("verb_lemma")).withColumn("entity_text", F.col("verb_lemma"))
    related = spark.createDataFrame([("agencia", "acción"), ("agencia", "gestión")], "key_1 string, key_2 string")
    return coref.expansions(f, related).groupBy("role", "is_expansion").agg(F.count(F.lit(1)).alias("n"))


@query(
    "verbs_under_negation",
    f"""with {_NEGATIONS}, {_VERBS.split(f"{_PARSED}, ", 1)[1]} select vf.pos, exists (select 1 from ng where ng.uce_id = vf.uce_id and ng.s = vf.s and vf.i between ng.i and ng.i + 5) as negacion, count(*) as n from vf group by all""",
)
def verbs_under_negation(spark: SparkSession, folder: str) -> DataFrame:
    """Verbs within five tokens after a negation of their sentence."""
    return unit_grammar.negated_verbs(spoken(spark, folder), "texto")


@query(
    "frames_with_verbs",
    f"""with {_VERBS}, a as (select vf.uce_id, vf.i, vf.voz, vf.perifrasis from vf) select voz, perifrasis, count(*) as n from a group by all""",
)
def frames_with_verbs(spark: SparkSession, folder: str) -> DataFrame:
    """The grammar of each frame's verb, by the same place."""
    t = parsed(spark, folder).withColumn("char_start", F.col("i")).withColumn("char_end", F.col("i") + 1)
    v = grammar.verbs(t)
    frames_ = t.where(F.col("pos").isin("VERB", "AUX")).select("doc_id", "uce_id", "char_start", "char_end")
    return frames_.join(v.select("doc_id", "uce_id", "char_start", "char_end", "voz", "perifrasis"), ["doc_id", "uce_id", "char_start", "char_end"]).groupBy("voz", "perifrasis").agg(F.count(F.lit(1)).alias("n"))


@query(
    "token_surprisal",
    f"""with {_LEXICON.replace(_LEMMAS, _LEMMAS + ", " + _TAGGED.split(f"{UNITS}, ", 1)[1])}, z as (select g.uce_id, g.i, -log2(greatest(coalesce(l.subtlwf, 0.01) / 1e6, 1e-10)) as bits from g left join l on l.termino = g.w where pos in ('NOUN', 'VERB', 'ADJ', 'ADV') and alpha)
select uce_id, count(*)::int as n, round(sum(bits), 6) as bits from z group by uce_id""",
)
def token_surprisal(spark: SparkSession, folder: str) -> DataFrame:
    """Content tokens of each unit and their surprisal in all."""
    from tesela.plans.grammar_plans import tokens

    t = tokens(spark, folder).withColumn("char_start", F.col("i"))
    got = grammar.surprisal_map(t, lexicon(spark, folder))
    return rounded(got.select("uce_id", F.size("sorpresa").alias("n"), F.aggregate(F.map_values("sorpresa"), F.lit(0.0), lambda a, x: a + x).alias("bits")))


@query(
    "grammar_by_class",
    f"""with {_NEGATIONS}, {_VERBS.split(f"{_PARSED}, ", 1)[1]}, al as (select uce_id, 'negacion' as familia, 'tipo' as clave, tipo as valor from ng union all select uce_id, 'verbo', 'voz', voz from vf union all select uce_id, 'verbo', 'perifrasis', cast(perifrasis as varchar) from vf)
select familia, cluster_id, clave, valor, count(*) as n from al join u using (uce_id) where valor is not null and cluster_id is not null group by all""",
)
def grammar_by_class(spark: SparkSession, folder: str) -> DataFrame:
    """Counts of the annotations' attributes in each class."""
    t = parsed(spark, folder)
    found = grammar.annotations(negacion=grammar.negations(t).select("doc_id", "uce_id", "i", "tipo"), verbo=grammar.verbs(t).select("doc_id", "uce_id", "i", "voz", "perifrasis"))
    return grammar.feature_counts(found.join(units(spark, folder, "cluster_id").where("cluster_id is not null"), "uce_id"), "cluster_id")


# --- classes and space -------------------------------------------------------------------------------


@query(
    "stability_verdicts",
    f"""with {UNITS}, {CONTEXT_UNITS}, x as (select u.uce_id, u.cluster_id as clase, coalesce(u.is_stable, false) as a, coalesce(c.is_stable, false) as b from u left join c using (uc_id))
select uce_id, clase, a or b as estable, case when a and b then 'uce_uc' when a then 'uce' when b then 'uc' else 'inestable' end as etiqueta from x""",
)
def stability_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    """What two ways of finding stable units say together."""
    u = units(spark, folder, "uc_id", "cluster_id", "is_stable")
    c = context_units(spark, folder, "is_stable").withColumnRenamed("is_stable", "estable")
    one = u.select("uce_id", "cluster_id", F.col("is_stable").alias("estable"))
    two = u.select("uce_id", "uc_id", "cluster_id").join(c, "uc_id").select("uce_id", "cluster_id", "estable")
    return classify.verdicts({"uce": one, "uc": two}, "uce_id", "cluster_id", "any")


@query(
    "latent_terms",
    f"""with {_VECTORS}, w as (select 'u' || uc_id as word, v, 0.1 + (orden % 20) * 0.1 as cd from e where orden % 2 = 0),
s as (select cluster_id as clase, word, list_cosine_similarity(v, centroide) * greatest(0, 1 - abs(ln(cd + 1e-6))) as puntaje from w, z)
select clase, word, round(puntaje, 6) as puntaje from (select *, row_number() over (partition by clase order by round(puntaje, 9) desc, word) as puesto from s) where puesto <= 20""",
)
def latent_terms(spark: SparkSession, folder: str) -> DataFrame:
    """Words (here the context units of even place) near each class that the vocabulary lacks (here those of odd place)."""
    u = _embedded(spark, folder).where(usable("embedding", DIM))
    words = u.select(F.concat(F.lit("u"), "uc_id").alias("word"), F.col("embedding").alias("vec"), (0.1 + (F.col("orden") % 20) * 0.1).alias("cd"), "orden")
    used = words.where("orden % 2 <> 0").select(F.col("word").alias("termino"))
    got = space.latent_vocabulary(words.drop("orden"), used, space.class_centroids(_embedded(spark, folder), "cluster_id", "embedding", DIM), "cluster_id")
    return rounded(got.select("clase", "word", "puntaje"))


@query(
    "reweighted_edges",
    f"""with {_VECTORS}, p as (select a.uc_id as a, b.uc_id as b, a.v as va, b.v as vb from e a join e b on a.doc_id = b.doc_id and b.orden = a.orden + 1)
select a, b, round(0.5 + 0.5 * greatest(0, list_cosine_similarity(va, vb)), 6) as peso from p""",
)
def reweighted_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Neighbouring context units, the weight of each pair by the likeness of its vectors."""
    u = _embedded(spark, folder).where(usable("embedding", DIM))
    after = u.select("doc_id", (F.col("orden") - 1).alias("orden"), F.col("uc_id").alias("b"))
    edges = u.select("doc_id", "orden", F.col("uc_id").alias("a")).join(after, ["doc_id", "orden"]).select("a", "b", F.lit(1.0).alias("peso"))
    return rounded(network.reweighted(edges, u.select(F.col("uc_id").alias("word"), F.col("embedding").alias("vec")), "peso").select("a", "b", F.col("peso_semantico").alias("peso")))


@query(
    "rarest_terms",
    f"""with {_LEXICON}, b as (select uce_id, termino, min(zipf) as zipf from s group by all)
select uce_id, termino, round(zipf, 6) as zipf from (select *, row_number() over (partition by uce_id order by round(zipf, 9), termino) as r from b) where r <= 10""",
)
def rarest_terms(spark: SparkSession, folder: str) -> DataFrame:
    scored = lexical.with_lexicon(stems(spark, folder, "lemmas"), lexicon(spark, folder))
    return rounded(lexical.rarest(scored, "uce_id").select("uce_id", "termino", "zipf"))


# --- totals and stored collections -------------------------------------------------------------------


@query(
    "corpus_vocabulary",
    f"""with {_LEXICON}, v as (select termino, count(*) as freq_abs, count(distinct doc_id) as n_docs, min(zipf) as zipf, min(cd) as cd, bool_and(is_oov) as is_oov from s group by termino having count(distinct doc_id) >= 2)
select termino, freq_abs, n_docs, round(zipf, 6) as zipf, round(cd, 6) as cd, is_oov from (select *, row_number() over (order by freq_abs desc, termino) as r from v) where r <= 100""",
)
def corpus_vocabulary(spark: SparkSession, folder: str) -> DataFrame:
    """The hundred most frequent lemmas of two interviews or more, with what the lexicon tells."""
    scored = lexical.with_lexicon(stems(spark, folder, "lemmas"), lexicon(spark, folder))
    v = scored.groupBy("termino").agg(F.count(F.lit(1)).alias("freq_abs"), F.countDistinct("doc_id").alias("n_docs"), F.min("zipf").alias("zipf"), F.min("cd").alias("cd"), F.min("is_oov").alias("is_oov"))
    return rounded(v.where("n_docs >= 2").orderBy(F.desc("freq_abs"), "termino").limit(100))


@query(
    "corpus_totals",
    f"""with {_LEMMAS}, x as (select count(*) as tokens, count(distinct termino) as tipos from t)
select (select count(distinct doc_id) from u) as entrevistas, (select count(*) from u) as unidades, (select count(distinct cluster_id) from u where cluster_id <> -1) as clases, tokens, tipos, round(tipos / tokens, 6) as ttr from x""",
)
def corpus_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Interviews, units, classes, tokens and types in all."""
    u = units(spark, folder, "doc_id", "cluster_id")
    counts = u.agg(F.countDistinct("doc_id").alias("entrevistas"), F.count(F.lit(1)).alias("unidades"), F.countDistinct(F.when(F.col("cluster_id") != -1, F.col("cluster_id"))).alias("clases"))
    t = stems(spark, folder, "lemmas")
    tokens, kinds = t.agg(F.count(F.lit(1))).scalar(), t.agg(F.countDistinct("termino")).scalar()
    whole = counts.withColumn("tokens", tokens).withColumn("tipos", kinds)
    return rounded(whole.withColumn("ttr", F.col("tipos") / F.col("tokens")))


@query("units_with_text", f"with {UNITS}, {CORPUS} select uce_id, doc_id, md5(coalesce(texto_completo_txt, '')) as huella from u left join d using (doc_id) where doc_id is not null")
def units_with_text(spark: SparkSession, folder: str) -> DataFrame:
    """Units with a digest of their whole interview."""
    d = corpus(spark, folder, "texto_completo_txt").select("doc_id", F.md5(F.coalesce("texto_completo_txt", F.lit("")).cast("binary")).alias("h"))
    return units(spark, folder, "doc_id").where("doc_id is not null").join(d, "doc_id", "left").select("uce_id", "doc_id", F.coalesce("h", F.md5(F.lit("").cast("binary"))).alias("huella"))


@query("stored_units", f"with {UNITS} select uce_id, doc_id, cluster_id, false as falta from u union all select null, null, null, true")
def stored_units(spark: SparkSession, folder: str) -> DataFrame:
    """Units written as a collection and read again; one that is not there is empty."""
    where = store(spark)
    sinks.save(units(spark, folder, "doc_id", "cluster_id"), where, "uces")
    sinks.save(units(spark, folder, "doc_id", "cluster_id"), where, "uces")  # written anew, not twice
    read = readers.collection(spark, where, "uces").withColumn("falta", F.lit(False))
    missing = readers.collection(spark, where, "network", "uce_id string, doc_id long, cluster_id int")
    note = missing.agg(F.first("uce_id").alias("uce_id"), F.first("doc_id").alias("doc_id"), F.first("cluster_id").alias("cluster_id"), (F.count(F.lit(1)) == 0).alias("falta"))
    return read.unionByName(note)


@query(
    "lexicon_from_file",
    f"with {_LEXICON} select termino as word, round(cast(fc as double), 6) as freqcount, round(subtlwf, 6) as subtlwf, round(zipf, 6) as zipf, round(cd, 6) as cd, round(cd, 6) as cd_2 from x join l using (termino)",
)
def lexicon_from_file(spark: SparkSession, folder: str) -> DataFrame:
    """The corpus's lexicon written as a frequency list and read by both readers."""
    where = store(spark)
    x = lexicon(spark, folder)
    line = F.concat_ws(";", F.initcap("word"), "freqcount", "subtlwf", F.col("zipf") - 1, "cd")
    head = spark.createDataFrame([(0, "Lista de frecuencias"), (1, "Word;Freq. count;per million;Log freq;CD")], "o int, value string")
    lines = head.union(x.select(F.lit(2), line)).repartition(1).sortWithinPartitions("o")  # one file, as such lists come
    lines.select("value").write.text(f"{where}/lista")
    x.select(F.col("word").alias("Word"), (F.col("cd") * 100).alias("SUBTLCD")).write.csv(f"{where}/cd", sep=";", header=True)
    first = readers.frequency_lexicon(spark, f"{where}/lista")
    second = readers.contextual_diversity(spark, f"{where}/cd").withColumnRenamed("cd", "cd_2")
    return rounded(first.join(second, "word"))


@query(
    "class_state_json",
    f"""with {SPANS}, x as (select trait, count(*) as n, list_sort(list(distinct agent) filter (agent is not null))[1:3] as agentes from s where trait is not null group by trait)
select trait, to_json({{'trait': trait, 'n': n, 'agentes': list_transform(agentes, lambda a: a[1:6])}})::varchar as json from x""",
)
def class_state_json(spark: SparkSession, folder: str) -> DataFrame:
    """State of each trait as JSON, its lists and texts bounded."""
    s = spans(spark, folder).where("trait is not null").groupBy("trait").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("agent")).alias("a"))
    kept = s.select("trait", "n", sinks.capped(F.col("a"), 3, 6).alias("agentes"))
    return sinks.as_json(kept).select(F.get_json_object("json", "$.trait").alias("trait"), "json")


@query(
    "master_documents",
    f"""with {UNITS}, {SPANS}, a as (select s.doc_id, s.uce_id, count(*) as n from s where start_char >= 0 group by all)
select u.doc_id, count(*) as n_uces, cast(sum(coalesce(a.n, 0)) as int) as anotaciones, arg_min(u.uce_id, (local_idx, u.uce_id)) as primera from u left join a on a.doc_id = u.doc_id and a.uce_id = u.uce_id where u.doc_id is not null and local_idx is not null group by u.doc_id""",
)
def master_documents(spark: SparkSession, folder: str) -> DataFrame:
    """What the nested document of each interview holds."""
    s = spans(spark, folder).where("start_char >= 0").select("doc_id", "uce_id", "start_char", "end_char", F.col("trait").alias("familia"), F.col("quote").alias("texto"))
    u = units(spark, folder, "doc_id", "local_idx").where("doc_id is not null and local_idx is not null").select("doc_id", "local_idx", "uce_id")
    got = sinks.master_document(u, s, "doc_id", "uce_id")
    total = F.aggregate("uces", F.lit(0), lambda n, x: n + F.greatest(F.size(x.anotaciones), F.lit(0)))
    return got.select("doc_id", "n_uces", total.alias("anotaciones"), F.col("uces")[0].uce_id.alias("primera"))


@query(
    "edges_as_gexf",
    f"""with {MATRIX}, nn as (select count(*) as n from u), e as (select a.termino as a, b.termino as b, count(*) as n from m a join m b on a.uce_id = b.uce_id and a.termino < b.termino group by all),
r as (select * from (select *, row_number() over (order by n desc, a, b) as r from e) where r <= 50) select count(*) as aristas, count(distinct x) as nodos from (select a as x, a, b from r union all select b, a, b from r) group by () """.replace("count(*) as aristas", "count(*) // 2 as aristas"),
)
def edges_as_gexf(spark: SparkSession, folder: str) -> DataFrame:
    """Edges and nodes of the graph export of the fifty most frequent pairs, counted in its XML."""
    import xml.etree.ElementTree as tree

    m, _ = matrix(spark, folder)
    top = network.pair_counts(m, "uce_id", least=1).orderBy(F.desc("conteo"), "a", "b").limit(50)
    edges = top.select("a", "b", F.col("conteo").cast("double").alias("peso")).checkpoint()
    nodes = edges.select(F.col("a").alias("nodo")).union(edges.select("b")).distinct().withColumn("comunidad", F.lit(0))
    root = tree.fromstring(network.gexf(nodes, edges, "peso"))
    count = {k: sum(1 for x in root.iter() if x.tag.rpartition("}")[2] == k) for k in ("edge", "node")}
    return spark.createDataFrame([(count["edge"], count["node"])], "aristas long, nodos long")


@query(
    "similar_vectors",
    """with e as (select vec_id, embedding::double[] as v from (select min(vec_id) as vec_id, embedding from embeddings where vec_id is not null and embedding is not null group by embedding)),
p as (select a.vec_id as key_1, b.vec_id as key_2, list_cosine_similarity(a.v, b.v) as coseno from e a join e b on a.vec_id < b.vec_id)
select key_1, key_2, round(coseno, 5) as coseno from (select *, row_number() over (partition by key_1 order by coseno desc, key_2) as r from p where coseno >= 0.5) where r <= 15""",
)
def similar_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Every two vectors of a cosine of one half or more, the fifteen best of each."""
    vectors = table(spark, folder, "embeddings").where("vec_id is not null and embedding is not null").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return rounded(coref.similar_pairs(vectors, "vec_id", "v", 0.5).drop("puesto"), 5)
