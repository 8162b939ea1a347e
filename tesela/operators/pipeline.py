"""The whole classification of a corpus, its parameter search and the providers behind it."""

from __future__ import annotations

import math
import random
from collections.abc import Callable
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesela.operators import classify, lexical, segmentation, space, terms


class Parser(Protocol):
    """Gives the token table of texts (see tesela.operators.grammar); grammar.rule_tokens is the built-in one."""

    def __call__(self, texts: DataFrame, doc: str, unit: str, text: str) -> DataFrame: ...


class Embedder(Protocol):
    """Adds an array<double> column ``vec`` to texts; hashed_embedding is the built-in one."""

    def __call__(self, texts: DataFrame, key: str, text: str) -> DataFrame: ...


def hashed_embedding(texts: DataFrame, key: str, text: str, dim: int = 64) -> DataFrame:
    """key, vec: normalised hashed tf-idf of the words, where no embedding model is at hand."""
    from pyspark.ml.feature import IDF, HashingTF, Normalizer
    from pyspark.ml.functions import vector_to_array

    from tesela.functions.text import words

    bags = HashingTF(inputCol="_w", outputCol="_tf", numFeatures=dim).transform(texts.select(key, F.coalesce(words(F.col(text)), F.array().cast("array<string>")).alias("_w")))
    weighted = IDF(inputCol="_tf", outputCol="_i").fit(bags).transform(bags)
    return Normalizer(inputCol="_i", outputCol="_n").transform(weighted).select(key, vector_to_array("_n").alias("vec"))


#: Parameters of a run and the values that the search tries.
DEFAULTS = {"min_forms": 10, "forms_gap": 4, "tsj": 3, "min_share": 0.1, "passes": 2, "min_r2": 0.05, "ppmi": False}
GRID = {"min_forms": (8, 10, 12, 14), "forms_gap": (2, 4, 6), "tsj": (3, 4, 5), "min_share": (0.05, 0.1, 0.15), "passes": (1, 2, 3), "min_r2": (0.02, 0.05, 0.1)}


def hashed_units(units: DataFrame) -> DataFrame:
    """uce_id, doc_id, local_idx, n, t: how many forms a unit has and the hashes of its different terms; read once and written."""
    terms_ = F.array_distinct(F.transform(F.filter("stems", lambda v: v.isNotNull() & (v != "")), lambda v: F.xxhash64(v)))
    return units.select("uce_id", "doc_id", "local_idx", F.greatest(F.size("stems"), F.lit(0)).alias("n"), F.coalesce(terms_, F.array().cast("array<bigint>")).alias("t")).checkpoint()


def one_classification(units: DataFrame, min_forms: int, tsj: int = 3, min_share: float = 0.1, passes: int = 2, min_r2: float = 0.05, ppmi: bool = False) -> DataFrame:
    """(uce_id, clase): context units of ``min_forms`` forms, their terms, their classes, and those of their units.

    ``units`` has uce_id, doc_id, local_idx and stems; with ``ppmi`` the first factor uses PPMI weights.
    """
    return _classified(hashed_units(units), min_forms, tsj, min_share, passes, min_r2, ppmi)


def _classified(hashed: DataFrame, min_forms: int, tsj: int, min_share: float, passes: int, min_r2: float, ppmi: bool) -> DataFrame:
    numbers = segmentation.context_units(hashed.select("doc_id", "local_idx", "n"), "doc_id", "local_idx", "n", min_forms)
    placed = numbers.select("doc_id", "local_idx", F.concat_ws("_", "doc_id", "uc_idx").alias("uc")).checkpoint()
    # a unit without terms adds nothing to the row of its context unit
    with_uc = hashed.where(F.size("t") > 0).select("doc_id", "local_idx", "t").join(placed, ["doc_id", "local_idx"])
    packed = with_uc.groupBy("uc").agg(F.array_distinct(F.flatten(F.collect_list("t"))).alias("t")).checkpoint()
    table = classify.with_terms(packed, "uc", classify.term_counts(packed, "uc", tsj))
    if ppmi:
        weighed = space.ppmi(table.select("uc", F.explode("t").alias("termino")), "uc")
        assigned, _ = classify.cdh(weighed, "uc", min_share=min_share, passes=passes, min_r2=min_r2, weight="ppmi")
    else:
        assigned, _ = classify.cdh_packed(table, "uc", min_share=min_share, passes=passes, min_r2=min_r2)
    classes = placed.join(assigned.select("uc", "clase"), "uc")
    return hashed.select("uce_id", "doc_id", "local_idx").join(classes, ["doc_id", "local_idx"]).select("uce_id", "clase").checkpoint()


def double_classification(units: DataFrame, **settings) -> tuple[DataFrame, float]:
    """((uce_id, clase, estable), adjusted Rand index) of classifications at two sizes of context unit."""
    s = {**DEFAULTS, **settings}
    plain = {k: s[k] for k in ("tsj", "min_share", "passes", "min_r2", "ppmi")}
    hashed = hashed_units(units)
    a = _classified(hashed, s["min_forms"], **plain)
    b = _classified(hashed, s["min_forms"] + s["forms_gap"], **plain)
    row = classify.adjusted_rand(classify.overlap(a, b, "uce_id", "clase", "clase")).first()
    return classify.stable_units(a, b, "uce_id", "clase", "clase"), float(row["ari"] or 0.0) if row else 0.0


def score(units: DataFrame, stable: DataFrame, ari: float) -> float:
    """2.5 ARI + 0.5 log(1 + significant terms) + 0.3 their share + 0.8 coverage, less 2 for a small class and 1.5 for each beyond eight."""
    kept = stable.where("estable").select("uce_id", "clase")
    sizes = [r["count"] for r in kept.groupBy("clase").count().collect()]
    if len(sizes) < 2:
        return -1e6
    stream = segmentation.term_stream(units, "uce_id", "stems")
    scored = terms.characteristic_terms(lexical.incidence(stream, "uce_id", lexical.vocabulary(stream, "uce_id")), kept, "uce_id", "clase")
    n, significant = scored.agg(F.count(F.lit(1)), F.count_if("significativo")).first()
    covered = sum(sizes) / max(stable.count(), 1)
    value = 2.5 * ari + 0.5 * math.log1p(significant) + 0.3 * significant / max(n, 1) + 0.8 * covered
    return value - (2 if min(sizes) < max(10, 0.08 * sum(sizes)) else 0) - 1.5 * max(0, len(sizes) - 8)


def search(units: DataFrame, trials: int = 20, seed: int = 42, run: Callable = double_classification) -> tuple[dict, float]:
    """Best settings and score of a pattern search: one parameter moves at a time from the best so far, in seeded order.

    The units are read once and written to the checkpoint folder, as all trials read them.
    """
    kept = units.checkpoint()
    r = random.Random(seed)
    best, tried = dict(DEFAULTS), set()
    top = score(kept, *run(kept, **best))
    for _ in range(trials - 1):
        key = r.choice(sorted(GRID))
        new = {**best, key: r.choice(GRID[key])}
        mark = tuple(sorted(new.items()))
        if mark in tried or new == best:
            continue
        tried.add(mark)
        value = score(kept, *run(kept, **new))
        if value > top:
            best, top = new, value
    return best, top


def class_prompt(label, terms_: list[tuple[str, float]], fragments: list[str], metadata: list[str] = ()) -> str:
    """What a model is asked to name and sum up a class: its terms with phi, three fragments, its metadata."""
    listed = ", ".join(f"{t} ({phi:.2f})" for t, phi in terms_)
    quoted = "\n".join(f"- {f}" for f in fragments[:3])
    return f"Clase {label}\nTérminos: {listed}\nFragmentos:\n{quoted}" + (f"\nMetadatos: {', '.join(metadata)}" if metadata else "")
