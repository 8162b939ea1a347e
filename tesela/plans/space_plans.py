"""Embedding space, classification, factors and segmentation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesela.operators import classify, factor, lexical, segmentation, space, terms
from tesela.operators.tables import context_units, table, unique, units
from tesela.plans.common_sql import CONTEXT_UNITS, MATRIX, UNITS
from tesela.plans.lexicon_plans import _TERMS, matrix, stems
from tesela.plans.registry import query, rounded

DIM = 32


def _embedded(spark: SparkSession, folder: str) -> DataFrame:
    """Context units with their class, vector and place in the document."""
    place = F.expr("try_cast(element_at(split(uc_id, '_'), -1) as int)")
    return context_units(spark, folder, "doc_id", "embedding", "cluster_id").withColumn("orden", place)


_VECTORS = f"""{CONTEXT_UNITS}, e as (select uc_id, doc_id, cluster_id, embedding::double[] as v, cast(string_split(uc_id, '_')[-1] as int) as orden from c
  where len(embedding) = 32 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
x as (select cluster_id, uc_id, unnest(v) as val, generate_subscripts(v, 1) as j from e where cluster_id is not null and cluster_id <> -1),
y as (select cluster_id, j, avg(val) as m from x group by all),
z as (select cluster_id, list(m order by j) as centroide from y group by cluster_id)"""


@query("class_centroids", f"with {_VECTORS} select cluster_id, (select count(*) from e where e.cluster_id = z.cluster_id) as n, list_transform(centroide, lambda q: round(q, 6)) as centroide from z")
def class_centroids(spark: SparkSession, folder: str) -> DataFrame:
    return space.class_centroids(_embedded(spark, folder), "cluster_id", "embedding", DIM).withColumn("centroide", F.transform("centroide", lambda x: F.round(x, 6)))


@query("class_distance", f"with {_VECTORS} select a.cluster_id as clase_1, b.cluster_id as clase_2, case when a.cluster_id = b.cluster_id then 0.0 else round(1 - list_cosine_similarity(a.centroide, b.centroide), 6) end as distancia from z a, z b")
def class_distance(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(space.class_distances(space.class_centroids(_embedded(spark, folder), "cluster_id", "embedding", DIM), "cluster_id"))


_SOFT = f"""{_VECTORS}, s as (select uc_id, z.cluster_id as clase, list_cosine_similarity(v, centroide) / 0.1 as s from e, z),
p as (select uc_id, clase, exp(s - max(s) over w) / sum(exp(s - 50)) over w * exp(max(s) over w - 50) as pertenencia from s window w as (partition by uc_id))"""


@query("soft_membership", f"with {_SOFT} select uc_id, clase, round(pertenencia, 5) as pertenencia from p")
def soft_membership(spark: SparkSession, folder: str) -> DataFrame:
    u = _embedded(spark, folder)
    return rounded(space.soft_membership(u, space.class_centroids(u, "cluster_id", "embedding", DIM), "uc_id", "cluster_id", "embedding", DIM), 5)


@query(
    "liminal_units",
    f"""with {_SOFT}, h as (select uc_id, -sum(pertenencia * ln(pertenencia + 1e-12)) as entropia, arg_max(clase, pertenencia) as dominante from p group by uc_id),
md as (select quantile_cont(entropia, 0.5) as m from h), ad as (select quantile_cont(abs(entropia - m), 0.5) as d from h, md)
select uc_id, round(entropia, 5) + 0.0 as entropia, dominante, entropia > m + d as liminal from h, md, ad""",
)
def liminal_units(spark: SparkSession, folder: str) -> DataFrame:
    u = _embedded(spark, folder)
    return rounded(space.liminal(space.soft_membership(u, space.class_centroids(u, "cluster_id", "embedding", DIM), "uc_id", "cluster_id", "embedding", DIM), "uc_id"), 5)


@query(
    "class_trajectory",
    f"""with {CONTEXT_UNITS}, o as (select uc_id, doc_id, cluster_id, cast(string_split(uc_id, '_')[-1] as int) as orden from c)
select uc_id, doc_id, orden, cluster_id, case when lag(orden) over w is null then 0 when cluster_id is distinct from lag(cluster_id) over w then 1 else 0 end as cambio from o window w as (partition by doc_id order by orden)""",
)
def class_trajectory(spark: SparkSession, folder: str) -> DataFrame:
    got = space.trajectory(_embedded(spark, folder).drop("embedding"), "doc_id", "orden", "cluster_id")
    return got.select("uc_id", "doc_id", "orden", "cluster_id", F.col("cambio").cast("int").alias("cambio"))


@query(
    "topic_shift",
    f"""with {_VECTORS} select uc_id, round(coalesce(1 - list_cosine_similarity(v, lag(v) over (partition by doc_id order by orden)), 1.0), 6) as topic_shift from e""",
)
def topic_shift(spark: SparkSession, folder: str) -> DataFrame:
    from tesela.functions.vectors import usable

    u = _embedded(spark, folder).where(usable("embedding", DIM))
    return rounded(segmentation.topic_shift(u, "doc_id", "orden", "embedding").select("uc_id", "topic_shift"))


_COHESION = f"""{_VECTORS}, h as (select uc_id, doc_id, orden, (list_cosine_similarity(v, lag(v) over (partition by doc_id order by orden)) + 1) / 2 as cohesion from e),
hh as (select * from h where cohesion is not null)"""


@query(
    "smoothed_cohesion",
    f"""with {_COHESION} select uc_id, round((cohesion + coalesce(lag(cohesion) over w, cohesion) + coalesce(lead(cohesion) over w, cohesion)) / 3, 6) as suave from hh window w as (partition by doc_id order by orden)""",
)
def smoothed_cohesion(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(_smoothed(spark, folder).select("uc_id", "suave"))


def _smoothed(spark: SparkSession, folder: str) -> DataFrame:
    from tesela.functions.vectors import usable

    u = _embedded(spark, folder).where(usable("embedding", DIM))
    near = segmentation.cohesion(u, "doc_id", "orden", "embedding").where("cohesion is not null")
    return segmentation.smoothed(near, "doc_id", "orden", "cohesion")


@query(
    "cohesion_segments",
    f"""with recursive {_COHESION}, sm as (select doc_id, orden, (cohesion + coalesce(lag(cohesion) over w, cohesion) + coalesce(lead(cohesion) over w, cohesion)) / 3 as s from hh window w as (partition by doc_id order by orden)),
fl as (select doc_id, orden, row_number() over w - 1 as k, 0.6 - s >= 0.05 and coalesce(lag(s) over w, s) >= s and coalesce(lead(s) over w, s) >= s as c, lead(orden) over w is null as u from sm window w as (partition by doc_id order by orden)),
r as (select doc_id, orden, k, u as corta, 0 as segmento, case when u then 0 else -1 end as ultima from fl where k = 0
  union all select fl.doc_id, fl.orden, fl.k, fl.u or (fl.c and fl.k - r.ultima >= 2), r.segmento + r.corta::int, case when fl.u or (fl.c and fl.k - r.ultima >= 2) then fl.k else r.ultima end from r join fl on fl.doc_id = r.doc_id and fl.k = r.k + 1)
select doc_id, segmento, min(orden) as desde, max(orden) as hasta, count(*) as n from r group by all""",
)
def cohesion_segments(spark: SparkSession, folder: str) -> DataFrame:
    """Segments of context units between boundaries of cohesion."""
    marked = segmentation.boundaries(_smoothed(spark, folder).withColumn("seccion", F.lit("")), "doc_id", "orden", "suave", "seccion", 0.6)
    return segmentation.segment_ranges(marked, "doc_id", "orden")


@query("linear_segments")
def linear_segments(spark: SparkSession, folder: str) -> DataFrame:
    from tesela.functions.vectors import usable

    u = _embedded(spark, folder).where(usable("embedding", DIM))
    return segmentation.grouped(u, "doc_id", "orden", "embedding", segmentation.linear_groups)


@query("recursive_segments")
def recursive_segments(spark: SparkSession, folder: str) -> DataFrame:
    from tesela.functions.vectors import usable

    u = _embedded(spark, folder).where(usable("embedding", DIM))
    return segmentation.grouped(u, "doc_id", "orden", "embedding")


_SPACE = r"\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_PIECE = rf"[{_SPACE}]*(?:[\p{{L}}\p{{N}}]+(?:[''’\-][\p{{L}}\p{{N}}]+)*|[^\p{{L}}\p{{N}}_{_SPACE}]|_)"


@query(
    "reinert_units",
    rf"""with recursive sg as materialized (select distinct on (segmento_id) segmento_id, texto_literal as t from segmentos where segmento_id is not null and seccion is not null and seccion <> '' and seccion not in ('TEXTO_NO_ASIGNADO', 'I. Datos sociodemográficos y perfil profesional') and texto_literal is not null and texto_literal <> ''),
k0 as (select segmento_id, unnest(regexp_extract_all(t, '{_PIECE}')) as x, generate_subscripts(regexp_extract_all(t, '{_PIECE}'), 1) - 1 as i from sg),
k as materialized (select segmento_id, i, regexp_replace(x, '^[{_SPACE}]+', '') as w, sum(length(x)) over (partition by segmento_id order by i) as e, count(*) over (partition by segmento_id) as n from k0),
g as materialized (select *, case when w in ('?', '!', '.', '…') then 6.0 when w = ':' then 5.0 when w = ';' then 4.0 when w = ',' then 1.0 else 0.01 end::double as peso from k),
sw as (select segmento_id, i, n, list(peso) over (partition by segmento_id order by i rows between 24 following and 55 following) as l from g),
sc as (select segmento_id, i, list_transform(l, lambda x, j: x * (1.0::double / (abs(j + 23 - 40) + 1))) as l from sw where n - i > 56),
z as materialized (select segmento_id, i as desde, i + 24 + list_position(l, list_max(l)) as hasta from sc),
r as (select segmento_id, 0::bigint as desde from g where i = 0 union all select z.segmento_id, z.hasta from r join z on z.segmento_id = r.segmento_id and z.desde = r.desde),
v as materialized (select r.segmento_id, r.desde, coalesce(lead(r.desde) over (partition by r.segmento_id order by r.desde), p.n) as hasta from r join g p on p.segmento_id = r.segmento_id and p.i = 0),
y0 as materialized (select v.segmento_id, v.desde, (a.e - length(a.w))::int as start_char, b.e::int as end_char, (hasta - v.desde)::int as n_tokens
  from v join g a on a.segmento_id = v.segmento_id and a.i = v.desde join g b on b.segmento_id = v.segmento_id and b.i = hasta - 1 where v.desde < hasta),
y as materialized (select y0.*, substring(t, start_char + 1, end_char - start_char) as texto from y0 join sg using (segmento_id))
select segmento_id, (row_number() over (partition by segmento_id order by desde) - 1)::int as local_idx, start_char, end_char, n_tokens, texto from y where len(regexp_extract_all(texto, '[^{_SPACE}]+')) >= 3""",
)
def reinert_units(spark: SparkSession, folder: str) -> DataFrame:
    """Elementary units of every analysed segment."""
    from tesela.sources.readers import analysed

    segments = analysed(unique(table(spark, folder, "segmentos"), "segmento_id"), "seccion", "texto_literal")
    return segmentation.elementary_units(segments, "segmento_id", "texto_literal")


@query(
    "context_unit_sizes",
    f"""with recursive {UNITS}, o as (select doc_id, uce_id, coalesce(len(lemmas), 0) as n, row_number() over (partition by doc_id order by local_idx, uce_id) as k from u where doc_id is not null and local_idx is not null),
r as (select doc_id, uce_id, k, 0 as uc, n as s from o where k = 1
  union all select o.doc_id, o.uce_id, o.k, case when r.s >= 10 then r.uc + 1 else r.uc end, case when r.s >= 10 then o.n else r.s + o.n end from r join o on o.doc_id = r.doc_id and o.k = r.k + 1)
select doc_id, uc as uc_idx, count(*) as n_uces from r group by all""",
)
def context_unit_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """Context units of ten forms or more: how many elementary units each has."""
    u = units(spark, folder, "doc_id", "local_idx", "lemmas").where("doc_id is not null and local_idx is not null")
    u = u.withColumn("orden", F.concat(F.lpad(F.col("local_idx").cast("string"), 10, "0"), F.lit("/"), "uce_id")).withColumn("n", F.greatest(F.size("lemmas"), F.lit(0)))
    return segmentation.context_units(u, "doc_id", "orden", "n").groupBy("doc_id", "uc_idx").agg(F.count(F.lit(1)).alias("n_uces"))


_INTERVALS = """i as (select distinct on (segmento_id) * from segmentos where segmento_id is not null),
j as (select doc_id, idx, segmento_id, seccion, coalesce(sum(coalesce(length(texto_literal), 0) + 2) over (partition by doc_id order by idx rows between unbounded preceding and 1 preceding), 0) as s_start, coalesce(length(texto_literal), 0) as n from i)"""


@query(
    "section_interval_join",
    f"""with {UNITS}, {_INTERVALS}, p as (select u.uce_id, u.doc_id, j.s_start + u.start_char as inicio from u join j using (segmento_id) where u.start_char is not null)
select p.uce_id, arg_min(coalesce(q.seccion, 'Sin_Seccion'), q.s_start) as seccion from p join j q on q.doc_id = p.doc_id and p.inicio >= q.s_start and p.inicio < q.s_start + q.n group by p.uce_id""",
)
def section_interval_join(spark: SparkSession, folder: str) -> DataFrame:
    """Section of each unit by its place in the document."""
    segments = unique(table(spark, folder, "segmentos").select("segmento_id", "doc_id", "idx", "seccion", "texto_literal"), "segmento_id")
    placed = segmentation.interval_starts(segments, "doc_id", "idx", "texto_literal")
    u = units(spark, folder, "doc_id", "segmento_id", "start_char").where("start_char is not null")
    starts = u.join(placed.select("segmento_id", "s_start"), "segmento_id").select("uce_id", "doc_id", (F.col("s_start") + F.col("start_char")).alias("inicio"))
    named = placed.select("doc_id", "s_start", "s_end", F.coalesce("seccion", F.lit("Sin_Seccion")).alias("seccion"))
    return segmentation.section_of(starts, named, "doc_id", "inicio").where("seccion is not null").select("uce_id", "seccion")


@query(
    "section_numbers",
    f"""with {_INTERVALS}, n as (select *, coalesce(seccion, 'Sin_Seccion') as s from j), f as (select doc_id, s, min(idx) as f from n group by all), r as (select doc_id, s, row_number() over (partition by doc_id order by f, s) - 1 as section_id from f)
select segmento_id, s as seccion, section_id from n join r using (doc_id, s)""",
)
def section_numbers(spark: SparkSession, folder: str) -> DataFrame:
    segments = unique(table(spark, folder, "segmentos").select("segmento_id", "doc_id", "idx", "seccion"), "segmento_id")
    return segmentation.section_numbers(segments, "doc_id", "idx").select("segmento_id", "seccion", F.col("section_id").cast("long").alias("section_id"))


@query(
    "ppmi_matrix",
    f"""with {MATRIX}, s as (select count(*) as s from m), a as (select uce_id, count(*) as nu from m group by uce_id), b as (select termino, count(*) as nt from m group by termino)
select uce_id, termino, round(greatest(0, ln((1.0 / s) / ((nu / s) * (nt / s)))), 6) as ppmi from m join a using (uce_id) join b using (termino), s""",
)
def ppmi_matrix(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(space.ppmi(matrix(spark, folder)[0], "uce_id"))


@query(
    "overlap_matrix",
    f"""with {UNITS}, {CONTEXT_UNITS} select u.cluster_id as clase_1, c.cluster_id as clase_2, count(*) as n from u join c using (uc_id) where u.cluster_id is not null and c.cluster_id is not null group by all""",
)
def overlap_matrix(spark: SparkSession, folder: str) -> DataFrame:
    return classify.overlap(*_partitions(spark, folder), "uce_id", "clase_u", "clase_c")


def _partitions(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Two partitions of the units: their own class and that of their context unit."""
    u = units(spark, folder, "uc_id", "cluster_id")
    c = context_units(spark, folder, "cluster_id").withColumnRenamed("cluster_id", "clase_c")
    both = u.withColumnRenamed("cluster_id", "clase_u").join(c, "uc_id").where("clase_u is not null and clase_c is not null")
    return both.select("uce_id", "clase_u"), both.select("uce_id", "clase_c")


@query(
    "adjusted_rand",
    f"""with {UNITS}, {CONTEXT_UNITS}, o as (select u.cluster_id as a, c.cluster_id as b, count(*) as n from u join c using (uc_id) where u.cluster_id is not null and c.cluster_id is not null group by all),
x as (select sum(n * (n - 1) / 2) as s, sum(n) as n from o), y as (select sum(n * (n - 1) / 2) as a from (select sum(n) as n from o group by a)), z as (select sum(n * (n - 1) / 2) as b from (select sum(n) as n from o group by b))
select cast(x.n as bigint) as n, round((s - a * b / (x.n * (x.n - 1) / 2)) / ((a + b) / 2 - a * b / (x.n * (x.n - 1) / 2)), 6) as ari from x, y, z""",
)
def adjusted_rand(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(classify.adjusted_rand(overlap_matrix(spark, folder)))


@query(
    "stable_units",
    f"""with {UNITS}, {CONTEXT_UNITS}, b as (select u.uce_id, u.cluster_id as x, c.cluster_id as y from u join c using (uc_id) where u.cluster_id is not null and c.cluster_id is not null), o as (select x, y, count(*) as n from b group by all),
m as (select x, y from (select *, max(n) over (partition by x) as nx, max(n) over (partition by y) as ny from o) where n = nx and n = ny)
select b.x as clase, m.x is not null as estable, count(*) as n from b left join m on m.x = b.x and m.y = b.y group by all""",
)
def stable_units(spark: SparkSession, folder: str) -> DataFrame:
    """Units whose two classes are matched one to one."""
    return classify.stable_units(*_partitions(spark, folder), "uce_id", "clase_u", "clase_c").groupBy("clase", "estable").agg(F.count(F.lit(1)).alias("n"))


def _listed_terms(df: DataFrame, most: int = 500_000) -> DataFrame:
    """A table of terms, written once; it is broadcast if it has at most ``most`` rows, so that no cells are shuffled by term."""
    kept = df.checkpoint()
    return F.broadcast(kept) if kept.count() <= most else kept


def _context_matrix(spark: SparkSession, folder: str) -> DataFrame:
    """(uc_id, termino), each once, parted by uc_id: a unit's terms are made distinct in its row."""
    u = units(spark, folder, "uc_id", "stems").where("uc_id is not null")
    lowered = F.filter(F.transform("stems", lambda v: F.lower(F.btrim(v, F.lit(" \t")))), lambda v: v.isNotNull() & (v != ""))
    t = u.select("uc_id", lowered.alias("v")).groupBy("uc_id").agg(F.array_distinct(F.flatten(F.collect_list("v"))).alias("v")).select("uc_id", F.explode("v").alias("termino"))
    common = t.groupBy("termino").agg(F.count(F.lit(1)).alias("n")).where("n >= 3").select("termino")
    return t.join(_listed_terms(common), "termino", "left_semi").select("uc_id", "termino")


@query("cdh_classes")
def cdh_classes(spark: SparkSession, folder: str) -> DataFrame:
    """Descending hierarchical classification of the context units: size of each leaf."""
    assigned, _ = classify.cdh(_context_matrix(spark, folder), "uc_id")
    return assigned.groupBy("nodo", "clase").agg(F.count(F.lit(1)).alias("n"))


@query("cdh_stability")
def cdh_stability(spark: SparkSession, folder: str) -> DataFrame:
    """Two classifications, of all terms and of those in five units or more: units that keep their class."""
    u = units(spark, folder, "uc_id", "stems").where("uc_id is not null")
    lowered = F.filter(F.transform("stems", lambda v: F.lower(F.btrim(v, F.lit(" \t")))), lambda v: v.isNotNull() & (v != ""))
    hashed = u.select("uc_id", F.transform(lowered, lambda v: F.xxhash64(v)).alias("t"))
    packed = hashed.groupBy("uc_id").agg(F.array_distinct(F.flatten(F.collect_list("t"))).alias("t")).checkpoint()
    counts = classify.term_counts(packed, "uc_id", 3)
    a, _ = classify.cdh_packed(classify.with_terms(packed, "uc_id", counts), "uc_id")
    b, _ = classify.cdh_packed(classify.with_terms(packed, "uc_id", counts.where("n >= 5")), "uc_id")
    kept = classify.stable_units(a, b, "uc_id", "clase", "clase")
    return kept.groupBy("clase", "estable").agg(F.count(F.lit(1)).alias("n"))


@query("ca_coordinates")
def ca_coordinates(spark: SparkSession, folder: str) -> DataFrame:
    """Coordinates of the classes and the stems on two axes."""
    m, k = matrix(spark, folder)
    rows, columns, _ = factor.correspondence(lexical.class_term_counts(m, k.where("cluster_id is not null and cluster_id <> -1"), "uce_id", "cluster_id"), "cluster_id")
    both = rows.select(F.lit("clase").alias("tipo"), F.col("cluster_id").cast("string").alias("nombre"), "eje", "principal", "estandar", "contribucion")
    return rounded(both.unionByName(columns.select(F.lit("termino").alias("tipo"), F.col("termino").alias("nombre"), "eje", "principal", "estandar", "contribucion")))


@query("ca_units")
def ca_units(spark: SparkSession, folder: str) -> DataFrame:
    m, k = matrix(spark, folder)
    _, columns, _ = factor.correspondence(lexical.class_term_counts(m, k.where("cluster_id is not null and cluster_id <> -1"), "uce_id", "cluster_id"), "cluster_id")
    return rounded(factor.supplementary(m, columns, "uce_id"))


@query("mca_terms")
def mca_terms(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(factor.multiple_correspondence(matrix(spark, folder)[0], "uce_id")[1])


@query("term_dendrogram")
def term_dendrogram(spark: SparkSession, folder: str) -> DataFrame:
    m, k = matrix(spark, folder)
    _, columns, _ = factor.correspondence(lexical.class_term_counts(m, k.where("cluster_id is not null and cluster_id <> -1"), "uce_id", "cluster_id"), "cluster_id")
    return rounded(factor.merge_frame(spark, factor.dendrogram(columns)))


@query("class_dendrogram")
def class_dendrogram(spark: SparkSession, folder: str) -> DataFrame:
    m, k = matrix(spark, folder)
    scored = terms.characteristic_terms(m, k, "uce_id", "cluster_id")
    return rounded(factor.merge_frame(spark, factor.class_dendrogram(m, scored, k, "uce_id", "cluster_id", 0)), 9)


@query(
    "semantic_diversity",
    f"""with {_VECTORS}, n as (select uc_id, doc_id, list_transform(v, lambda q: q / sqrt(list_dot_product(v, v))) as v from e), d as (select doc_id, unnest(v) as q, generate_subscripts(v, 1) as j from n),
s as (select doc_id, j, sum(q) as s from d group by all), r as (select doc_id, sum(s * s) as r from s group by doc_id), c as (select doc_id, count(*) as n from n group by doc_id)
select doc_id, n, round(1 - (r - n) / (n * (n - 1)), 6) as diversidad from r join c using (doc_id) where n > 1""".replace(", c as (select doc_id", ", cc as (select doc_id").replace("join c using", "join cc using"),
)
def semantic_diversity(spark: SparkSession, folder: str) -> DataFrame:
    """Mean cosine distance of the context units of an interview."""
    from tesela.functions.vectors import usable

    return rounded(lexical.semantic_diversity(_embedded(spark, folder).where(usable("embedding", DIM)), "doc_id", "embedding"))


_SCORED = _TERMS.replace("* sqrt(chi2 / n), 4) as phi", "* sqrt(chi2 / n), 4) + 0.0 as phi")


@query(
    "constraint_graph",
    f"""with w as ({_SCORED}), h as (select *, row_number() over (partition by cluster_id order by chi2_yates desc, termino) as r from w where significativo and phi > 0)
select a.termino as a, b.termino as b, round(max(least(a.chi2_yates, b.chi2_yates)), 6) as peso from h a join h b on a.cluster_id = b.cluster_id and a.termino < b.termino and a.r <= 50 and b.r <= 50 group by all""",
)
def constraint_graph(spark: SparkSession, folder: str) -> DataFrame:
    m, k = matrix(spark, folder)
    return rounded(space.constraint_graph(terms.characteristic_terms(m, k, "uce_id", "cluster_id"), "cluster_id"))


@query("retrofitted_vectors")
def retrofitted_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Stem vectors (means over their context units) drawn towards their class mates; how far each one moved."""
    from tesela.functions.vectors import cosine, mean_vector, usable

    t = stems(spark, folder)
    u = units(spark, folder, "uc_id").join(_embedded(spark, folder).where(usable("embedding", DIM)).select("uc_id", "embedding"), "uc_id")
    common = lexical.vocabulary(t, "uce_id", min_units=3).select("termino")
    vectors = t.join(common, "termino", "left_semi").join(u.select("uce_id", "embedding"), "uce_id").groupBy(F.col("termino").alias("word")).agg(mean_vector("embedding", DIM).alias("vec")).checkpoint()
    moved = space.retrofit(vectors, constraint_graph(spark, folder), DIM, rounds=10)
    both = vectors.join(moved.withColumnRenamed("vec", "nuevo"), "word")
    return rounded(both.select("word", cosine(F.col("vec"), F.col("nuevo")).alias("coseno")), 5)


@query("double_classification")
def double_classification(spark: SparkSession, folder: str) -> DataFrame:
    """Classes of the elementary units that hold at two sizes of context unit, and how many units keep theirs."""
    from tesela.operators.pipeline import double_classification as run

    u = units(spark, folder, "doc_id", "local_idx", "stems").where("doc_id is not null and local_idx is not null")
    first = u.dropDuplicates(["doc_id", "local_idx"])
    return run(first)[0].groupBy("clase", "estable").agg(F.count(F.lit(1)).alias("n"))


@query("term_embeddings")
def term_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors of all stems of the vocabulary from their PPMI."""
    return space.term_embeddings(space.ppmi(matrix(spark, folder)[0], "uce_id"), "uce_id", 16).withColumn("vec", F.transform("vec", lambda x: F.round(x, 5)))


@query("similar_stems")
def similar_stems(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of stems that are alike."""
    from tesela.operators.coref import similar_pairs

    return rounded(similar_pairs(term_embeddings(spark, folder), "word", "vec", 0.8), 5)


@query(
    "centroid_export",
    f"""with w as ({_SCORED}), h as (select *, row_number() over (partition by cluster_id order by chi2_yates desc, termino) as r from w where phi > 0), l as (select cluster_id, list(termino order by r) as terminos from h where r <= 10 group by cluster_id), {_VECTORS}
select cluster_id, (select count(*) from e where e.cluster_id = z.cluster_id) as n, list_transform(centroide, lambda q: round(q, 6)) as centroide, terminos from z left join l using (cluster_id)""",
)
def centroid_export(spark: SparkSession, folder: str) -> DataFrame:
    """Centroids of the classes with their most telling stems."""
    m, k = matrix(spark, folder)
    return space.centroid_export(class_centroids(spark, folder), terms.characteristic_terms(m, k, "uce_id", "cluster_id"), "cluster_id")
