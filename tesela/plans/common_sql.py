"""Parts of the SQL oracles."""

#: One row per unit and per context unit.
UNITS = "u as (select distinct on (uce_id) * from uces where uce_id is not null)"
CONTEXT_UNITS = "c as (select distinct on (uc_id) * from ucs where uc_id is not null)"
CORPUS = "d as (select distinct on (doc_id) * from corpus where doc_id is not null)"


def lower(value: str) -> str:
    """Small letters with the final sigma, which lower() here lacks."""
    return rf"regexp_replace(lower({value}), '(\pL)σ($|[^\pL])', '\1ς\2', 'g')"


def terms(column: str, name: str = "t") -> str:
    """(uce_id, doc_id, cluster_id, i, termino) of an array column of the units."""
    return f"""{name} as (select * from (select uce_id, doc_id, cluster_id, i - 1 as i, {lower("trim(valor, ' ' || chr(9))")} as termino
  from (select uce_id, doc_id, cluster_id, unnest({column}) as valor, generate_subscripts({column}, 1) as i from u)) where termino <> '')"""


#: Vocabulary, incidence and known classes of the stems.
MATRIX = f"""{UNITS}, {terms('stems')},
v as (select termino, count(distinct uce_id) as unidades from t group by termino having count(distinct uce_id) >= 3),
m as (select distinct uce_id, termino from t join v using (termino)),
k as (select uce_id, cluster_id from u where cluster_id is not null and cluster_id <> -1)"""
