"""Rule-based grammar over the tokens of the units."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesela.functions import text as T
from tesela.operators import coref, grammar, unit_grammar
from tesela.operators import lexicon_es as es
from tesela.operators.tables import units
from tesela.plans.common_sql import UNITS
from tesela.plans.registry import query, rounded


def spoken(spark: SparkSession, folder: str) -> DataFrame:
    """The units that have a text and an interview."""
    return units(spark, folder, "doc_id", "texto").where("texto is not null and doc_id is not null")


def tokens(spark: SparkSession, folder: str) -> DataFrame:
    return grammar.rule_tokens(spoken(spark, folder), "doc_id", "uce_id", "texto")


def kept_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """The same, written once for rules that read them several times."""
    return tokens(spark, folder).checkpoint()


def parsed(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens with the heads, labels and endings of the shallow parse, written once."""
    return grammar.shallow_parse(tokens(spark, folder)).checkpoint()


def _listed(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


_TOKENS = rf"""{UNITS}, k0 as (select uce_id, unnest(regexp_extract_all(texto, '([\p{{L}}\p{{M}}]+(?:[''’\-][\p{{L}}\p{{M}}]+)*|\p{{N}}+(?:[.,]\p{{N}}+)*|[^\s\p{{L}}\p{{N}}])')) as tx,
  generate_subscripts(regexp_extract_all(texto, '([\p{{L}}\p{{M}}]+(?:[''’\-][\p{{L}}\p{{M}}]+)*|\p{{N}}+(?:[.,]\p{{N}}+)*|[^\s\p{{L}}\p{{N}}])'), 1) as i from u where texto is not null and doc_id is not null),
k as (select uce_id, tx, lower(tx) as w, i from k0)"""


_VERB_END = "(?:me|te|se|lo|la|los|las|le|les|nos)?$"
#: The built-in tagger: g (uce_id, doc_id, i, tx, w, punct, pos, s).
_TAGGED = rf"""{_TOKENS}, g0 as (select k.uce_id, u.doc_id, (i - 1)::int as i, tx, w, not regexp_matches(tx, '^[\p{{L}}\p{{N}}]') as punct, regexp_matches(tx, '^\p{{L}}') as alpha,
  coalesce(sum((tx in ('.', '?', '!', '…'))::int) over (partition by k.uce_id order by i rows between unbounded preceding and 1 preceding), 0)::int as s from k join u using (uce_id)),
g as (select *, case when punct then 'PUNCT' when regexp_matches(tx, '^\p{{N}}') then 'NUM' when w in ({_listed(es.ARTICLES)}) then 'DET' when w in ({_listed(es.PREPOSITIONS)}) then 'ADP'
  when w in ({_listed(es.PRONOUNS)}) then 'PRON' when w in ({_listed(es.AUXILIARIES)}) then 'AUX' when w in ({_listed(es.CONJUNCTIONS)}) then 'CCONJ'
  when w in ({_listed(k for k in es.SUBORDINATORS if " " not in k)}) then 'SCONJ' when w in ({_listed(es.INTERJECTIONS)}) then 'INTJ' when w in ({_listed(es.NEGATORS)}) then 'ADV'
  when w in ({_listed(w for v in es.QUANTIFIERS.values() for w in v)}) then 'DET' when w in ({_listed(w for v in es.ADVERBS.values() for w in v if " " not in w)}) or regexp_matches(w, 'mente$') then 'ADV'
  when regexp_matches(w, '(?:ar|er|ir|ando|iendo|aba|aban|ía|ían|ó|aron|ieron){_VERB_END}') then 'VERB' when regexp_matches(w, '(?:oso|osa|able|ible|ico|ica|al|ivo|iva)s?$') then 'ADJ' else 'NOUN' end as pos,
  case when regexp_matches(w, '(?:ar|er|ir){_VERB_END}') then 'Inf' when regexp_matches(w, '(?:ando|iendo){_VERB_END}') then 'Ger' else 'Fin' end as form from g0)"""
#: Their heads: p has also h, d (label), pv and the root of the sentence.
_PARSED = f"""{_TAGGED}, n as (select *, last_value(case when pos = 'VERB' then i end ignore nulls) over b as pv, first_value(case when pos = 'VERB' then i end ignore nulls) over a as nv,
  last_value(case when pos = 'NOUN' then i end ignore nulls) over b as pn, first_value(case when pos = 'NOUN' then i end ignore nulls) over a as nn, last_value(case when pos = 'ADP' then i end ignore nulls) over b as pa,
  last_value(case when pos = 'SCONJ' then i end ignore nulls) over b as ps, coalesce(min(case when pos = 'VERB' then i end) over z, min(case when pos = 'AUX' then i end) over z, min(i) over z) as root
  from g window b as (partition by uce_id, s order by i rows between unbounded preceding and 1 preceding), a as (partition by uce_id, s order by i rows between 1 following and unbounded following), z as (partition by uce_id, s)),
n2 as (select *, case when pv is null then nv when nv is null then pv when i - pv <= nv - i then pv else nv end as near, coalesce(pa, -1) > greatest(coalesce(pn, -1), coalesce(pv, -1)) as adp, nn is not null and nn - i <= 3 as close from n),
p as (select *, case when i = root then {{'h': i, 'd': 'root'}} when pos = 'PUNCT' then {{'h': root, 'd': 'punct'}}
  when pos in ('DET', 'NUM', 'ADJ') and close then {{'h': nn, 'd': case pos when 'DET' then 'det' when 'NUM' then 'nummod' else 'amod' end}}
  when pos = 'ADJ' and pn is not null then {{'h': pn, 'd': 'amod'}} when pos = 'ADP' and close then {{'h': nn, 'd': 'case'}}
  when pos = 'NOUN' and adp and pn is not null and pn > coalesce(pv, -1) then {{'h': pn, 'd': 'nmod'}} when pos = 'NOUN' and adp and near is not null then {{'h': near, 'd': 'obl'}}
  when pos = 'NOUN' and pv is null and nv is not null then {{'h': nv, 'd': 'nsubj'}} when pos = 'NOUN' and pv is not null then {{'h': pv, 'd': 'obj'}}
  when pos = 'PRON' and near is not null then {{'h': coalesce(nv, pv), 'd': case when w = 'se' then 'expl' when w in ('le', 'les') then 'iobj' when w in ({_listed(es.CLITIC_PRONOUNS)}) then 'obj' else 'nsubj' end}}
  when pos = 'AUX' and nv is not null and nv - i <= 2 then {{'h': nv, 'd': 'aux'}} when pos = 'ADV' and near is not null then {{'h': near, 'd': 'advmod'}}
  when pos = 'SCONJ' and nv is not null then {{'h': nv, 'd': 'mark'}} when pos = 'CCONJ' then {{'h': root, 'd': 'cc'}} when pos = 'INTJ' then {{'h': root, 'd': 'discourse'}}
  when pos = 'VERB' then {{'h': root, 'd': case when form in ('Inf', 'Ger') and i - pv <= 3 then 'xcomp' when coalesce(ps, -1) > pv then 'advcl' else 'conj' end}} else {{'h': root, 'd': 'dep'}} end as l from n2),
q as (select uce_id, doc_id, s, i, tx, w, pos, form, alpha, punct, l.h as h, l.d as d, root from p)"""


@query("negation_tokens", f"with {_TOKENS} select uce_id, w as palabra, count(*) as n from k where w in ({_listed(es.NEGATORS)}) group by all")
def negation_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return tokens(spark, folder).where(F.col("lower").isin(es.NEGATORS)).groupBy("uce_id", F.col("lower").alias("palabra")).agg(F.count(F.lit(1)).alias("n"))


@query("polarity_items", f"with {_TOKENS} select w as palabra, count(*) as n, count(distinct uce_id) as unidades from k where w in ({_listed(es.NEGATIVE_POLARITY)}) group by all")
def polarity_items(spark: SparkSession, folder: str) -> DataFrame:
    t = tokens(spark, folder).where(F.col("lower").isin(es.NEGATIVE_POLARITY))
    return t.groupBy(F.col("lower").alias("palabra")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("uce_id").alias("unidades"))


_QUANTIFIERS = " ".join(f"when w in ({_listed(ws)}) then '{t}'" for t, ws in es.QUANTIFIERS.items())


@query("quantifier_profile", f"with {_TOKENS}, q as (select case {_QUANTIFIERS} end as tipo, w from k) select tipo, w as palabra, count(*) as n from q where tipo is not null group by all")
def quantifier_profile(spark: SparkSession, folder: str) -> DataFrame:
    """Quantifiers by type and word."""
    table = grammar.lookup(spark, [(w, t) for t, ws in es.QUANTIFIERS.items() for w in ws], "lower string, tipo string")
    return tokens(spark, folder).join(table, "lower").groupBy("tipo", F.col("lower").alias("palabra")).agg(F.count(F.lit(1)).alias("n"))


@query("pronoun_tokens", f"with {_TOKENS} select w as palabra, count(*) as n from k where w in ({_listed(es.PRONOUNS)}) group by all")
def pronoun_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return tokens(spark, folder).where(F.col("lower").isin(es.PRONOUNS)).groupBy(F.col("lower").alias("palabra")).agg(F.count(F.lit(1)).alias("n"))


_ENCLITIC = " ".join(f"when ends_with(w, '{c}') and length(w) >= {len(c) + 2} then '{c}'" for c in T.CLITICS)
_PRONOUNS = f"""{_PARSED}, r as (select 'EXPLICITO' as tipo, case when w in ({_listed(es.REFLEXIVES)}) then 'REFLEXIVO' else 'PERSONAL' end as subtipo from q where pos = 'PRON'
  union all select 'ENCLITICO', case {_ENCLITIC} end from q where pos = 'VERB' and form in ('Inf', 'Ger') and case {_ENCLITIC} end is not null
  union all select 'NULO', '3' || case when regexp_matches(w, '(?:aban|ían|aron|ieron)$') then 'Plur' else 'Sing' end from q where pos = 'VERB' and form = 'Fin'
    and not exists (select 1 from q x where x.uce_id = q.uce_id and x.s = q.s and x.h = q.i and x.i <> x.h and contains(x.d, 'subj'))
  union all select 'CONTRACCION', case w when 'al' then 'a+el' else 'de+el' end from q where w in ('al', 'del'))"""


@query(
    "pronoun_profile",
    f"""with {_PRONOUNS} select tipo, null as subtipo, cast(count(*) as double) as valor from r group by tipo union all select null, subtipo, count(*) from r group by subtipo
union all select 'RATIO_NULO', null, round(count(*) filter (tipo = 'NULO') / greatest(count(*) filter (tipo in ('NULO', 'EXPLICITO')), 1), 6) from r""",
)
def pronoun_profile(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(grammar.pronoun_profile(grammar.pronouns(parsed(spark, folder))))


def _hits(lexicon: dict[str, list[str]], most: int) -> str:
    """CTE ``hits``: phrases of a lexicon over the tagged tokens, the longest at each place first."""
    rows = ", ".join(f"('{w}', '{c}', {len(w.split())})" for c, ws in lexicon.items() for w in ws)
    leads = ", ".join(f"lead(w, {k}) over o as w{k}" for k in range(1, most))
    built = " ".join(f"when {k} then w" + "".join(f" || ' ' || w{j}" for j in range(1, k)) for k in range(1, most + 1))
    return f"""x as (select uce_id, s, i, w, {leads} from g where not punct window o as (partition by uce_id order by i)), lex(frase, categoria, n) as (values {rows}),
h0 as (select uce_id, s, i, frase, categoria, n from x join lex on case n {built} end = frase),
hits as (select * from (select *, coalesce(max(i + n) over (partition by uce_id order by i, n desc rows between unbounded preceding and 1 preceding), -1) as a from h0) where i >= a)"""


@query("adverb_profile", f"with {_TAGGED}, {_hits(es.ADVERBS, 5)} select categoria, frase, count(*) as n from hits where frase not in ({_listed(es.ADVERBS_BLOCKED)}) group by all")
def adverb_profile(spark: SparkSession, folder: str) -> DataFrame:
    return grammar.adverbs(kept_tokens(spark, folder)).groupBy("categoria", "frase").agg(F.count(F.lit(1)).alias("n"))


_MARKERS = f"""{_TAGGED}, {_hits(es.LOCUTIONS, 6)}, pl as (select *, case when coalesce(lag(punct) over o, true) then 'INICIO' when coalesce(lead(punct) over o, true) then 'FINAL' else 'MEDIAL' end as posicion from g window o as (partition by uce_id order by i)),
mk as (select hits.uce_id, hits.categoria, hits.frase, pl.posicion from hits join pl on pl.uce_id = hits.uce_id and pl.i = hits.i
  union all select uce_id, 'CONECTORES', w, posicion from pl where w in ({_listed(es.CONNECTORS)}) and pos in ('CCONJ', 'SCONJ', 'INTJ', 'ADV') and posicion <> 'MEDIAL')"""


@query("discourse_markers", f"with {_MARKERS} select categoria, frase, posicion, count(*) as n from mk group by all")
def discourse_markers(spark: SparkSession, folder: str) -> DataFrame:
    return grammar.discourse_markers(kept_tokens(spark, folder)).groupBy("categoria", "frase", "posicion").agg(F.count(F.lit(1)).alias("n"))


@query(
    "marker_density",
    f"""with {_MARKERS}, wd as (select uce_id, count(*) as palabras from g where not punct group by uce_id), c2 as (select uce_id, count(*) as marcadores from mk group by uce_id)
select uce_id, palabras, coalesce(marcadores, 0) as marcadores, round(coalesce(marcadores, 0) / palabras * 100, 6) as densidad from wd left join c2 using (uce_id)""",
)
def marker_density(spark: SparkSession, folder: str) -> DataFrame:
    counts = unit_grammar.marker_counts(spoken(spark, folder), "uce_id", "texto")
    return rounded(counts.withColumn("densidad", F.col("marcadores") / F.col("palabras") * 100))


_VERBS = f"""{_PARSED}, ch as (select uce_id, s, h as i, count(*) filter (d like 'nsubj%') as sujetos, count(*) filter (w = 'se' and d like 'expl%') as se,
  count(*) filter (d in ('xcomp', 'advcl') and pos = 'VERB' and form in ('Inf', 'Ger')) as cl from q where h <> i group by all),
vb as (select q.*, q.pos = 'VERB' and q.form = 'Fin' as fin, coalesce(sujetos, 0) as sujetos, coalesce(se, 0) as se, coalesce(cl, 0) as cl from q left join ch on ch.uce_id = q.uce_id and ch.s = q.s and ch.i = q.i where q.pos in ('VERB', 'AUX')),
vf as (select *, case when se > 0 and fin and sujetos > 0 then 'PASIVA_REFLEJA' when se > 0 and fin and not regexp_matches(w, '(?:aban|ían|aron|ieron)$') then 'IMPERSONAL' when se > 0 then 'MEDIA' else 'Act' end as voz,
  w in ({_listed(es.PERIPHRASIS_VERBS)}) and cl > 0 as perifrasis from vb)"""


@query("verb_profile", f"with {_VERBS} select pos, voz, perifrasis, count(*) as n from vf group by all")
def verb_profile(spark: SparkSession, folder: str) -> DataFrame:
    return grammar.verbs(parsed(spark, folder)).groupBy("pos", "voz", "perifrasis").agg(F.count(F.lit(1)).alias("n"))


_SUBORDINATORS = ", ".join(f"('{k}', '{a}', {repr(b) if b else 'null'})" for k, (a, b) in es.SUBORDINATORS.items() if " " not in k)
#: Words that the tagger has in a class before that of subordinators.
_EARLIER = _listed([*es.ARTICLES, *es.PREPOSITIONS, *es.PRONOUNS, *es.AUXILIARIES, *es.CONJUNCTIONS])


@query(
    "subordination_profile",
    f"with {_TOKENS}, l(w, tipo, subtipo) as (values {_SUBORDINATORS}) select w as lower, tipo, subtipo, count(*) as n from k join l using (w) where w not in ({_EARLIER}) group by all",
)
def subordination_profile(spark: SparkSession, folder: str) -> DataFrame:
    return grammar.subordinations(tokens(spark, folder)).groupBy("lower", "tipo", "subtipo").agg(F.count(F.lit(1)).alias("n"))


_OPENINGS = " ".join(f"when '{a}' then '{f}'" for a, f in es.INSUBORDINATION.items())


@query(
    "insubordination_profile",
    f"""with {_PARSED}, f1 as (select *, row_number() over o as r, lead(w) over o as w2 from q where not punct window o as (partition by uce_id, s order by i)),
f2 as (select f1.*, case when w || ' ' || w2 = 'pero si' then 'pero si' else w end as apertura, exists (select 1 from q x where x.uce_id = f1.uce_id and x.s = f1.s and x.i = f1.h and x.h = x.i) as raiz from f1 where r = 1)
select apertura, case apertura {_OPENINGS} end as funcion, count(*) as n from f2 where apertura in ({_listed(es.INSUBORDINATION)}) and pos in ('SCONJ', 'CCONJ') and (raiz or h = i) group by all""",
)
def insubordination_profile(spark: SparkSession, folder: str) -> DataFrame:
    return grammar.insubordinations(parsed(spark, folder)).groupBy("apertura", "funcion").agg(F.count(F.lit(1)).alias("n"))


_NEGATIONS = f"""{_PARSED}, n0 as (select q.*, hd.pos as hpos, up.pos as hhpos from q join q hd on hd.uce_id = q.uce_id and hd.s = q.s and hd.i = q.h join q up on up.uce_id = q.uce_id and up.s = q.s and up.i = hd.h where q.w in ({_listed(es.NEGATORS)})),
n1 as (select *, case when hpos in ('AUX', 'PART') then hhpos else hpos end as alcance_pos, hpos in ('AUX', 'PART') as sube from n0),
ng as (select *, case when d = 'advmod' then case when alcance_pos in ('VERB', 'AUX') then 'NEGACION_VERBAL' when alcance_pos in ('ADJ', 'ADV') then 'NEGACION_DE_GRADO' else 'NEGACION_ADVERBIAL' end
  when d = 'det' then 'NEGACION_NOMINAL' when d = 'cc' and w = 'ni' then 'NEGACION_CONJUNTIVA' else 'OTRA' end || case when alcance_pos in ('NOUN', 'PROPN', 'PRON', 'ADJ', 'ADV') and not sube then '_CONSTITUYENTE' else '' end as tipo from n1)"""
_RESTS = [part.split(f"{_PARSED}, ", 1)[1] for part in (_NEGATIONS, _VERBS)]


@query(
    "grammar_summary",
    f"""with {_MARKERS}, {_PARSED.split(f"{_TAGGED}, ", 1)[1]}, {", ".join(_RESTS)},
cq as (select case {_QUANTIFIERS} when pos = 'NUM' then 'NUMERAL_CARDINAL' end as tipo from q where pos in ('DET', 'PRON', 'ADJ', 'NUM')),
al as (select 'negacion' as familia, 'tipo' as clave, tipo as valor from ng union all select 'verbo', 'voz', voz from vf union all select 'verbo', 'perifrasis', cast(perifrasis as varchar) from vf
  union all select 'cuantificador', 'tipo', tipo from cq union all select 'marcador', 'categoria', categoria from mk union all select 'marcador', 'posicion', posicion from mk)
select familia, clave, valor, count(*) as n from al where valor is not null group by all""",
)
def grammar_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Counts of every attribute of the annotations, by family."""
    return unit_grammar.summary(spoken(spark, folder), "texto")


@query(
    "kwic_tengo_que",
    rf"""with {UNITS}, h as (select uce_id, texto, string_split(lower(texto), 'tengo que') as p from u where texto is not null and contains(lower(texto), 'tengo que')), x as (select uce_id, texto, unnest(p[1:-2]) as pieza, generate_subscripts(p[1:-2], 1) as j from h),
y as (select uce_id, texto, j - 1 as hit, sum(length(pieza) + 9) over (partition by uce_id order by j) - 9 as inicio from x)
select uce_id, hit, cast(inicio as int) as inicio, substring(texto, greatest(inicio - 40, 0)::int + 1, (inicio - greatest(inicio - 40, 0))::int) as izquierda, substring(texto, inicio::int + 10, 40) as derecha from y""",
)
def kwic_tengo_que(spark: SparkSession, folder: str) -> DataFrame:
    """Concordance of "tengo que" in the units."""
    return grammar.kwic(units(spark, folder, "texto"), "uce_id", "texto", "tengo que")


@query(
    "unit_projections",
    f"""with {_TAGGED}, m1 as (select *, pos in ('NOUN', 'VERB', 'ADJ', 'ADV') and alpha as con, alpha and pos in ('DET', 'ADP', 'PRON', 'AUX', 'CCONJ', 'SCONJ', 'INTJ') as mar from g)
select doc_id, uce_id, coalesce(list(tx order by i) filter (alpha and not punct), []) as tokens, coalesce(list(w order by i) filter (con), []) as lemmas, coalesce(list(pos order by i) filter (con), []) as pos_tags, coalesce(list(w order by i) filter (mar), []) as marcadores from m1 group by all""",
)
def unit_projections(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens, content lemmas, word classes and markers of each unit by the built-in tagger."""
    return grammar.unit_projection(tokens(spark, folder)).drop("formas")


@query(
    "complexity_profile",
    f"""with recursive {_PARSED}, dp as (select uce_id, s, h, 1 as n from q where h <> i union all select dp.uce_id, dp.s, q.h, n + 1 from dp join q on q.uce_id = dp.uce_id and q.s = dp.s and q.i = dp.h and q.h <> q.i where n < 50),
d1 as (select uce_id, least(max(n), 50)::int as profundidad from dp group by uce_id), d2 as (select uce_id, avg(abs(i - h)) as distancia, avg((i > h)::int) as ramificacion from q where h <> i group by uce_id),
d3 as (select doc_id, uce_id, count(distinct s) as oraciones, count(*) filter (d in ('ccomp', 'xcomp', 'advcl', 'acl', 'relcl', 'acl:relcl')) as recursividad from q group by all)
select doc_id, uce_id, oraciones, recursividad, coalesce(profundidad, 0) as profundidad, round(coalesce(distancia, 0), 6) as distancia, round(coalesce(ramificacion, 0.5), 6) as ramificacion, round(recursividad / oraciones, 6) as por_oracion
from d3 left join d1 using (uce_id) left join d2 using (uce_id)""",
)
def complexity_profile(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(grammar.complexity(parsed(spark, folder)))


@query("negation_profile", f"with {_NEGATIONS} select tipo, alcance_pos, count(*) as n from ng group by all")
def negation_profile(spark: SparkSession, folder: str) -> DataFrame:
    return grammar.negations(parsed(spark, folder)).groupBy("tipo", "alcance_pos").agg(F.count(F.lit(1)).alias("n"))


@query("speech_starts", f"""with {_TAGGED}, o1 as (select *, lead(tx, 1) over o as t1, lead(pos, 2) over o as p2 from g window o as (partition by uce_id order by i))
select uce_id, count(*) filter (w in ({_listed(grammar.PIVOTS)}) or w in ({_listed(grammar.PIVOTS_BEFORE_VERB)}) and t1 = ',' and p2 = 'VERB') as inicios from o1 group by uce_id""")
def speech_starts(spark: SparkSession, folder: str) -> DataFrame:
    """How many pivot words of speech each unit has."""
    return grammar.pivot_starts(tokens(spark, folder)).groupBy("uce_id").agg(F.count_if("inicia").alias("inicios"))


@query("units_of_substance", f"with {_TAGGED} select doc_id, uce_id, count(*) filter (pos in ('NOUN', 'VERB', 'ADJ', 'ADV')) >= 4 as sustancia from g group by all")
def units_of_substance(spark: SparkSession, folder: str) -> DataFrame:
    return grammar.has_substance(tokens(spark, folder))


@query(
    "unlicensed_polarity",
    f"""with {_TAGGED}, {_hits({"idioma": es.NPI_IDIOMS}, 5)}, z1 as (select *, coalesce(max((w in ({_listed(es.NEGATORS)}))::int) over o, 0) as neg, coalesce(max((pos in ('VERB', 'AUX'))::int) over o, 0) as vb
  from g window o as (partition by uce_id, s order by i rows between unbounded preceding and 1 preceding))
select uce_id, i, tx as text from z1 where w in ({_listed(w for w in es.NEGATIVE_POLARITY if w not in es.NEGATORS)}) and neg = 0 and vb = 1
  and not exists (select 1 from hits where hits.uce_id = z1.uce_id and hits.s = z1.s and z1.i between hits.i and hits.i + hits.n - 1)""",
)
def unlicensed_polarity(spark: SparkSession, folder: str) -> DataFrame:
    return grammar.unlicensed_npis(tokens(spark, folder)).select("uce_id", "i", "text")


@query(
    "verb_morphology",
    f"with {_VERBS} select case when fin then 'Ind' end as modo, case when fin then case when regexp_matches(w, '(?:ó|aron|ieron)$') then 'Past' else 'Imp' end end as tiempo, case when fin then '3' end as persona, "
    "case when fin then case when regexp_matches(w, '(?:aban|ían|aron|ieron)$') then 'Plur' else 'Sing' end end as numero, count(*) as n, cast(sum(case when fin then greatest(sujetos, 1) else sujetos end) as bigint) as sujetos from vf group by all",
)
def verb_morphology(spark: SparkSession, folder: str) -> DataFrame:
    """Mood, tense, person and number of the verbs, and their subjects, told or not."""
    return grammar.verbs(parsed(spark, folder)).groupBy("modo", "tiempo", "persona", "numero").agg(F.count(F.lit(1)).alias("n"), F.sum("sujetos").alias("sujetos"))


@query(
    "quantified_words",
    f"""with {_PARSED}, cq as (select q.*, case {_QUANTIFIERS} when pos = 'NUM' then 'NUMERAL_CARDINAL' end as tipo from q where pos in ('DET', 'PRON', 'ADJ', 'NUM'))
select cq.tipo, case when hd.pos in ('NOUN', 'PRON', 'PROPN') and cq.h <> cq.i then hd.tx end as cuantificado, count(*) as n from cq join q hd on hd.uce_id = cq.uce_id and hd.s = cq.s and hd.i = cq.h where cq.tipo is not null group by all""",
)
def quantified_words(spark: SparkSession, folder: str) -> DataFrame:
    return grammar.quantifiers(parsed(spark, folder)).groupBy("tipo", "cuantificado").agg(F.count(F.lit(1)).alias("n"))


_FRAMES = f"""{_VERBS}, ob as (select uce_id, s, h as i, arg_min(w, i) as ob from q where d = 'obj' and h <> i group by all),
dn as (select distinct uce_id, s, h as i from q where h <> i and w in ('no', 'nunca', 'jamás', 'tampoco')), pr as (select uce_id, s, h as i, arg_min(w, i) as pr from q where h <> i and d = 'case' group by all),
fr as (select a.uce_id, a.s, a.i as ai, v.i, a.w as entity, v.w as verb, v.voz, ob.ob, dn.i is not null as neg, a.d, pr.pr, case when a.d like 'nsubj%' then case when v.voz = 'Pass' then 'PATIENT' else 'AGENT' end when a.d = 'obj' then 'PATIENT' when a.d = 'iobj' then 'RECIPIENT'
  when a.d = 'obl' and pr.pr = 'por' then 'AGENT' when a.d = 'obl' and pr.pr in ('para', 'a') then 'RECIPIENT' when a.d = 'obl' then 'OBLIQUE' when a.d = 'nmod' then 'MODIFIER' else 'UNSPECIFIED' end as role
  from q a join vf v on v.uce_id = a.uce_id and v.s = a.s and v.i = a.h and v.pos = 'VERB' left join ob on ob.uce_id = v.uce_id and ob.s = v.s and ob.i = v.i left join dn on dn.uce_id = v.uce_id and dn.s = v.s and dn.i = v.i
  left join pr on pr.uce_id = a.uce_id and pr.s = a.s and pr.i = a.i where a.h <> a.i and regexp_matches(a.d, '^(nsubj|obj|iobj|obl|nmod)'))"""


@query("predicate_frames", f"with {_FRAMES} select verb || coalesce(' ' || ob, '') || ' ' || voz || case when neg then ' NEG' else '' end as fingerprint, role, count(*) as n from fr group by all")
def predicate_frames(spark: SparkSession, folder: str) -> DataFrame:
    """Frames of the parsed verbs by fingerprint and role."""
    t = parsed(spark, folder)
    return coref.frames(t, grammar.verbs(t)).groupBy("fingerprint", "role").agg(F.count(F.lit(1)).alias("n"))


@query("thematic_roles", f"with {_FRAMES} select role, neg as negated, voz as voice, count(*) as n, count(distinct entity) as entidades from fr group by all")
def thematic_roles(spark: SparkSession, folder: str) -> DataFrame:
    t = parsed(spark, folder)
    return coref.frames(t, grammar.verbs(t)).groupBy("role", "negated", "voice").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("entity_lemma").alias("entidades"))


@query("root_subjects", f"with {_PARSED} select q.w as palabra, count(*) as n from q where d like 'nsubj%' and h = root group by all")
def root_subjects(spark: SparkSession, folder: str) -> DataFrame:
    """Subjects of the roots of sentences."""
    head = grammar.with_head(parsed(spark, folder), "dep")
    return head.where("dep like 'nsubj%' and h_dep = 'root'").groupBy(F.col("lower").alias("palabra")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "adverb_windows",
    f"""with {_PARSED}, kd as (select uce_id, s, h, min(i) as lo, max(i) as hi from q where h <> i group by all), av as (select q.uce_id, q.i, least(q.i, q.h, coalesce(lo, q.i)) as l, greatest(q.i, q.h, coalesce(hi, q.i)) as r from q left join kd on kd.uce_id = q.uce_id and kd.s = q.s and kd.h = q.h where q.pos = 'ADV')
select uce_id, i, case when r - l > 20 then greatest(l, i - 10) else l end as desde, case when r - l > 20 then least(r, i + 10) else r end as hasta from av""",
)
def adverb_windows(spark: SparkSession, folder: str) -> DataFrame:
    return grammar.adverb_window(parsed(spark, folder)).select("uce_id", "i", "desde", "hasta")


@query(
    "dependency_profiles",
    f"with {_PARSED}, c3 as (select uce_id, d, count(*) as n from q group by all) select uce_id, d as dep, round(n / sum(n) over (partition by uce_id), 6) as p from c3",
)
def dependency_profiles(spark: SparkSession, folder: str) -> DataFrame:
    """Share of each label in the tokens of a unit."""
    return rounded(grammar.dependency_profile(parsed(spark, folder)).select("uce_id", F.explode("perfil").alias("dep", "p")))
