"""Metadata tests, profiles and alternation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesela.operators import metadata
from tesela.operators.tables import corpus, table, units
from tesela.plans.common_sql import CORPUS, UNITS
from tesela.plans.registry import query, rounded
from tesela.sources.readers import METADATA


def described_units(spark: SparkSession, folder: str) -> DataFrame:
    """Units with their class and the metadata of their interview."""
    d = corpus(spark, folder, "meta").select("doc_id", *(F.col("meta")[c].alias(c) for c in METADATA))
    return units(spark, folder, "doc_id", "cluster_id").join(d, "doc_id", "left").where("cluster_id is not null and cluster_id <> -1")


_META = f"""{UNITS}, {CORPUS}, w as (select u.uce_id, u.cluster_id, meta['Sexo'] as "Sexo", meta['Edad_Cat'] as "Edad_Cat", meta['Ocupacion_Cat'] as "Ocupacion_Cat"
  from u left join d using (doc_id) where cluster_id is not null and cluster_id <> -1)"""
_TABLE = """z as (select cluster_id, "Ocupacion_Cat" as v from w where "Ocupacion_Cat" is not null), r as (select cluster_id, count(*) as nf from z group by all), q as (select v, count(*) as nc from z group by all),
s as (select count(*) as t from z), o as (select cluster_id, v, count(*) as n from z group by all),
x as (select r.cluster_id, q.v, coalesce(n, 0) as n, nf * nc / t as esperado from r, q, s left join o on o.cluster_id = r.cluster_id and o.v = q.v)"""


@query(
    "metadata_residuals",
    f"""with {_META}, {_TABLE} select cluster_id, v as "Ocupacion_Cat", n, round(esperado, 6) as esperado, round((n - esperado) / sqrt(greatest(esperado, 1e-9)), 6) as residuo from x""",
)
def metadata_residuals(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(metadata.crosstab(described_units(spark, folder), "cluster_id", "Ocupacion_Cat"))


@query(
    "metadata_chi2",
    f"""with {_META}, {_TABLE}, y as (select sum(pow(n - esperado, 2) / greatest(esperado, 1e-9)) as chi2, sum(n) as n, count(distinct cluster_id) as r, count(distinct v) as c from x)
select 'Ocupacion_Cat' as variable, round(chi2, 6) as chi2, (r - 1) * (c - 1) as gl, cast(n as bigint) as n, round(sqrt(chi2 / (n * (least(r, c) - 1))), 6) as v from y""",
)
def metadata_chi2(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(metadata.chi2_test(described_units(spark, folder), "cluster_id", "Ocupacion_Cat").drop("p"))


@query("metadata_tests")
def metadata_tests(spark: SparkSession, folder: str) -> DataFrame:
    """Chi-square, degrees of freedom, V and p of every metadata column."""
    u = described_units(spark, folder)
    out = None
    for c in METADATA:
        one = metadata.chi2_test(u, "cluster_id", c)
        out = one if out is None else out.unionByName(one)
    return rounded(out)


@query("metadata_permutation")
def metadata_permutation(spark: SparkSession, folder: str) -> DataFrame:
    d = corpus(spark, folder, "meta").select("doc_id", F.col("meta")["Sexo"].alias("sexo"), F.col("meta")["Edad_Cat"].alias("edad"))
    return rounded(metadata.permutation_test(d, "doc_id", "sexo", "edad", 1000))


@query(
    "anova_eta2",
    """with k as (select c_mktsegment as g, c_acctbal as x from customer where c_mktsegment is not null and c_acctbal is not null), s as (select g, count(*) as n, avg(x) as m, var_samp(x) as v from k group by g),
t as (select sum(n) as n, count(*) as k, sum(n * m) / sum(n) as mu, sum((n - 1) * v) as w, sum(n * m * m) as q from s), b as (select *, q - n * mu * mu as b from t)
select 'c_acctbal' as variable, cast(k - 1 as bigint) as gl_1, cast(n - k as bigint) as gl_2, round((b / (k - 1)) / (w / (n - k)), 6) as f, round(b / (b + w), 6) as eta2 from b""",
)
def anova_eta2(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(metadata.anova(table(spark, folder, "customer"), "c_mktsegment", "c_acctbal").drop("p"))


@query("anova_p")
def anova_p(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(metadata.anova(table(spark, folder, "customer"), "c_mktsegment", "c_acctbal"))


@query("rf_importance")
def rf_importance(spark: SparkSession, folder: str) -> DataFrame:
    """Loss of accuracy of a forest that predicts the class from metadata."""
    return rounded(metadata.forest(described_units(spark, folder), "cluster_id", ["Sexo", "Edad_Cat", "Ocupacion_Cat"], trees=200, depth=8, key="uce_id")[0])


@query(
    "describe_numeric",
    """select 'l_quantity' as variable, count(l_quantity) as n, round(avg(l_quantity), 6) as media, round(stddev_samp(l_quantity), 6) as desv, min(l_quantity) as minimo, quantile_cont(l_quantity, 0.25) as q1, quantile_cont(l_quantity, 0.5) as mediana, quantile_cont(l_quantity, 0.75) as q3, max(l_quantity) as maximo from lineitem
union all select 'l_discount', count(l_discount), round(avg(l_discount), 6), round(stddev_samp(l_discount), 6), min(l_discount), quantile_cont(l_discount, 0.25), quantile_cont(l_discount, 0.5), quantile_cont(l_discount, 0.75), max(l_discount) from lineitem""",
)
def describe_numeric(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(metadata.described(table(spark, folder, "lineitem"), "l_quantity", "l_discount"))


@query(
    "feature_entropies",
    """with z as (select 'agent' as rasgo, agent as valor from s union all select 'trait', trait from s union all select 'confidence', confidence from s), c as (select rasgo, valor, count(*) as n from z where valor is not null group by all),
p as (select *, n / sum(n) over (partition by rasgo) as p, row_number() over (partition by rasgo order by n desc, valor) as r from c)
select rasgo, cast(sum(n) as bigint) as n, count(*) as niveles, round(-sum(p * ln(p)), 6) as entropia, string_agg(valor, ', ' order by r) filter (r <= 3) as principales from p group by rasgo""".replace("from s", "from (select distinct on (span_id) * from spans)"),
)
def feature_entropies(spark: SparkSession, folder: str) -> DataFrame:
    s = table(spark, folder, "spans").select("span_id", "agent", "trait", "confidence").dropDuplicates(["span_id"])
    long = s.select(F.explode(F.create_map(*(x for c in ("agent", "trait", "confidence") for x in (F.lit(c), F.col(c))))).alias("rasgo", "valor"))
    return rounded(metadata.entropy_by(long, "rasgo", "valor"))


@query("profile_grouping_sets", "select agent, trait, count(*) as n from (select distinct on (span_id) * from spans) group by grouping sets ((agent), (trait))")
def profile_grouping_sets(spark: SparkSession, folder: str) -> DataFrame:
    return metadata.profile(table(spark, folder, "spans").select("span_id", "agent", "trait").dropDuplicates(["span_id"]), "agent", "trait")


_EVENTS = "e as (select *, lag(event_type) over (partition by user_id order by ts, event_id) as b from events where event_type is not null)"


@query(
    "state_alternation",
    f"""with {_EVENTS}, c as (select user_id, event_type, count(*) as c, count(*) filter (b is not null and b <> event_type) as k from e group by all)
select user_id, cast(sum(c) as bigint) as n, cast(sum(k) as bigint) as cambios, (list(event_type order by c desc, event_type))[1] as modal, round(case when sum(c) > 1 then sum(k) / (sum(c) - 1) else 0 end, 6) as tasa from c group by user_id""",
)
def state_alternation(spark: SparkSession, folder: str) -> DataFrame:
    """Changes of state of each user: the analogue of voice alternation."""
    return rounded(metadata.alternation(table(spark, folder, "events"), "user_id", ["ts", "event_id"], "event_type"))


@query("state_transitions", f"with {_EVENTS} select b as desde, event_type as hasta, count(*) as n from e where b <> event_type group by all")
def state_transitions(spark: SparkSession, folder: str) -> DataFrame:
    return metadata.transitions(table(spark, folder, "events"), "user_id", ["ts", "event_id"], "event_type")


@query(
    "classes_by_voice",
    f"""with {UNITS} select cluster_id, pos, count(*) as n from (select cluster_id, unnest(pos_tags) as pos from u where cluster_id is not null) where pos is not null group by all""",
)
def classes_by_voice(spark: SparkSession, folder: str) -> DataFrame:
    """Word classes of each class."""
    u = units(spark, folder, "cluster_id", "pos_tags").where("cluster_id is not null")
    return u.select("cluster_id", F.explode("pos_tags").alias("pos")).where("pos is not null").groupBy("cluster_id", "pos").agg(F.count(F.lit(1)).alias("n"))


@query(
    "class_summary",
    f"""with {UNITS} select cluster_id, count(*) as unidades, cast(sum(coalesce(len(lemmas), 0)) as bigint) as palabras, count(distinct doc_id) as entrevistas, round(avg(is_stable::int), 6) as estables from u where cluster_id is not null group by cluster_id""",
)
def class_summary(spark: SparkSession, folder: str) -> DataFrame:
    u = units(spark, folder, "cluster_id", "lemmas", "doc_id", "is_stable").where("cluster_id is not null")
    got = u.groupBy("cluster_id").agg(
        F.count(F.lit(1)).alias("unidades"), F.sum(F.greatest(F.size("lemmas"), F.lit(0))).alias("palabras"), F.countDistinct("doc_id").alias("entrevistas"), F.avg(F.col("is_stable").cast("double")).alias("estables")
    )
    return rounded(got)
