"""Vocabulary, frequencies, bands, richness and lexicon profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Zipf bands, from the most frequent words down: name and lower and upper bound.
ZIPF_BANDS = (("B1", 6, 9), ("B2", 5, 6), ("B3", 4, 5), ("B4", 3, 4), ("B5", 0, 3))
#: What a word outside the lexicon counts as.
OOV = {"subtlwf": 0.01, "zipf": 1.0, "cd": 0.001, "freqcount": 0.0}


def vocabulary(terms: DataFrame, unit: str, term: str = "termino", min_units: int = 3) -> DataFrame:
    """Terms in at least ``min_units`` units with their document frequency and place in code-point order.

    The place is made by a range partition and the counts before each part: no task sees all terms.
    """
    kept = terms.groupBy(term).agg(F.countDistinct(unit).alias("unidades")).where(F.col("unidades") >= min_units)
    return with_rank(kept, [F.col(term)], "indice", start=0)


def with_rank(df: DataFrame, order: list[Column], name: str, start: int = 1, by: str | None = None) -> DataFrame:
    """Adds a running number in ``order``, anew for each value of ``by`` if given; no task sees all rows.

    A range sort is written to the checkpoint folder with the place of each row in its partition, so that
    all that is counted from it sees the same partitions; a row's number is its place and the sizes of the
    partitions before. With ``by`` the first number of each value is taken off.
    """
    keys = [*([F.col(by)] if by else []), *order]
    placed = df.orderBy(*keys).withColumn("_p", F.spark_partition_id()).withColumn("_n", F.monotonically_increasing_id()).checkpoint()
    sizes = placed.groupBy("_p").agg(F.count(F.lit(1)).alias("_c"), F.min("_n").alias("_first"))
    before = F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))  # one row per partition
    starts = sizes.select("_p", (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift"))
    numbered = placed.join(F.broadcast(starts), "_p").withColumn(name, (F.col("_n") + F.col("_shift") + start).cast("long")).drop("_p", "_n", "_shift")
    if by is None:
        return numbered
    first = numbered.groupBy(by).agg(F.min(name).alias("_least"))
    return numbered.join(first, by).withColumn(name, F.col(name) - F.col("_least") + start).drop("_least")


def incidence(terms: DataFrame, unit: str, vocab: DataFrame, term: str = "termino") -> DataFrame:
    """(unit, term), each once, of the terms of the vocabulary: the sparse binary matrix."""
    return terms.select(unit, term).distinct().join(vocab.select(term), term, "left_semi").select(unit, term)


def class_term_counts(incidence: DataFrame, classes: DataFrame, unit: str, label: str, term: str = "termino") -> DataFrame:
    """Units of each class with each term."""
    return incidence.join(classes, unit).groupBy(label, term).agg(F.count(F.lit(1)).alias("unidades"))


def zipf_profile(terms: DataFrame, unit: str, term: str = "termino") -> DataFrame:
    """Rank, frequency, relative frequency (6 places), empirical Zipf value and units of every term."""
    counts = terms.groupBy(term).agg(F.count(F.lit(1)).alias("freq_abs"), F.countDistinct(unit).alias("n_docs"))
    total = counts.agg(F.sum("freq_abs")).scalar()
    ranked = with_rank(counts, [F.desc("freq_abs"), F.col(term)], "rango").withColumn("t", total)
    share = F.col("freq_abs") / F.col("t")
    return ranked.select(
        "rango", term, "freq_abs", F.round(share, 6).alias("freq_rel"), F.log10(share * 1e6 + 1).alias("zipf_empirico"), "n_docs",
    )


def with_lexicon(terms: DataFrame, lexicon: DataFrame, term: str = "termino") -> DataFrame:
    """Adds zipf, cd, subtlwf, freqcount and is_oov; a word outside the lexicon has the fixed values of OOV."""
    joined = terms.join(lexicon.withColumnRenamed("word", term).withColumn("_in", F.lit(True)), term, "left")
    return joined.withColumn("is_oov", F.col("_in").isNull()).drop("_in").fillna(OOV)


def band(zipf: Column) -> Column:
    out = None
    for name, low, high in ZIPF_BANDS:
        inside = (zipf >= low) & (zipf < high)
        out = F.when(inside, name) if out is None else out.when(inside, name)
    return out


def band_profile(scored: DataFrame, term: str = "termino") -> DataFrame:
    """Tokens, types and shares of each Zipf band; words outside the lexicon count again as B_oov."""
    by_band = scored.select(band(F.col("zipf")).alias("banda"), term).where("banda is not null")
    oov = scored.where("is_oov").select(F.lit("B_oov").alias("banda"), term)
    counted = by_band.union(oov).groupBy("banda").agg(F.count(F.lit(1)).alias("n_tokens"), F.countDistinct(term).alias("n_types"))
    total = scored.agg(F.count(F.lit(1))).scalar()
    running = Window.orderBy("banda").rowsBetween(Window.unboundedPreceding, 0)  # six rows
    return counted.withColumn("t", total).select(
        "banda", "n_tokens", "n_types", (F.col("n_tokens") / F.col("t") * 100).alias("pct"),
        F.when(F.col("banda") != "B_oov", F.sum(F.col("n_tokens") / F.col("t") * 100).over(running)).alias("pct_acum"),
    )


def richness(terms: DataFrame, unit: str, term: str = "termino", order: str = "i", first: int = 35) -> DataFrame:
    """Tokens, types, ttr, Guiraud's index, hapax, entropy in nats and types among the first 35 of each unit."""
    counts = terms.groupBy(unit, term).agg(F.count(F.lit(1)).alias("c"), F.min(order).alias("primero"))
    return counts.groupBy(unit).agg(
        F.sum("c").alias("n_tokens"), F.count(F.lit(1)).alias("n_types"), F.count_if(F.col("c") == 1).alias("hapax"),
        F.sum(F.col("c") * F.ln("c")).alias("_h"), F.count_if(F.col("primero") < first).alias("d_aprox"),
    ).select(
        unit, "n_tokens", "n_types", "hapax", "d_aprox", (F.col("n_types") / F.col("n_tokens")).alias("ttr"),
        (F.col("n_types") / F.sqrt("n_tokens")).alias("guiraud"), (F.ln("n_tokens") - F.col("_h") / F.col("n_tokens")).alias("entropia"),
    )


def mtld(terms: Column, threshold: float = 0.72) -> Column:
    """Mean length of runs whose type-token ratio stays at ``threshold`` or more, with the open run's share.

    A fold over the array in the JVM; 0 for an empty one.
    """
    start = F.struct(F.array().cast("array<string>").alias("vistos"), F.lit(0).alias("n"), F.lit(0.0).alias("factores"))

    def step(state: Column, word: Column) -> Column:
        seen, n = F.array_union(state.vistos, F.array(word)), state.n + 1
        closed = (F.size(seen) / n) < threshold
        return F.when(closed, F.struct(F.array().cast("array<string>").alias("vistos"), F.lit(0).alias("n"), (state.factores + 1.0).alias("factores"))).otherwise(
            F.struct(seen.alias("vistos"), n.alias("n"), state.factores.alias("factores"))
        )

    def end(state: Column) -> Column:
        rest = F.when(state.n > 0, (1 - F.size(state.vistos) / state.n) / (1 - threshold)).otherwise(0.0)
        factors = state.factores + rest
        return F.when(factors > 0, F.size(terms) / factors).otherwise(F.size(terms).cast("double"))

    return F.aggregate(terms, start, step, end)


def summary_by(measures: DataFrame, group: str, *columns: str) -> DataFrame:
    """Count, mean and sample deviation (4 places) of ``columns`` by a metadata value."""
    stats = [x for c in columns for x in (F.round(F.avg(c), 4).alias(f"{c}_media"), F.round(F.stddev_samp(c), 4).alias(f"{c}_desv"))]
    return measures.where(F.col(group).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("n"), *stats)


def distinctive(terms: DataFrame, group: str, top: int = 10, term: str = "termino") -> DataFrame:
    """The ``top`` terms of each group by tf (ln((T + 1) / (f + 1)) + 1), T the corpus total, f the term's total.

    The rank limit is applied in each partition before the exchange.
    """
    counts = terms.where(F.col(group).isNotNull()).groupBy(group, term).agg(F.count(F.lit(1)).alias("f_grupo"))
    total = counts.groupBy(term).agg(F.sum("f_grupo").alias("f_total"))
    size = counts.groupBy(group).agg(F.sum("f_grupo").alias("n_grupo"))
    corpus = counts.agg(F.sum("f_grupo")).scalar()
    score = F.col("f_grupo") / F.col("n_grupo") * (F.ln((F.col("t") + 1) / (F.col("f_total") + 1)) + 1)
    scored = counts.join(total, term).join(size, group).withColumn("t", corpus).withColumn("puntaje", F.round(score, 9))
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("puntaje"), term))
    return scored.withColumn("puesto", rank).where(F.col("puesto") <= top).select(group, "puesto", term, "f_grupo", "f_total", "puntaje")


def oov_terms(scored: DataFrame, unit: str, term: str = "termino") -> DataFrame:
    """Words outside the lexicon: occurrences and units."""
    return scored.where("is_oov").groupBy(term).agg(F.count(F.lit(1)).alias("freq_abs"), F.countDistinct(unit).alias("n_uces"))


def sophistication(scored: DataFrame, unit: str) -> DataFrame:
    """Mean Zipf value, its distance from 7, share of unknown and of rare words, ratios of register, load."""
    surprisal = -F.log2(F.greatest(F.col("subtlwf") / 1e6, F.lit(1e-10)))
    share = lambda condition: F.avg(condition.cast("double"))
    return scored.groupBy(unit).agg(
        F.avg("zipf").alias("mean_zipf"), (7 - F.avg("zipf")).alias("sofisticacion"), share(F.col("is_oov")).alias("pct_oov"),
        share(F.col("zipf") < 3).alias("pct_bajo"), share((F.col("zipf") >= 5) & (F.col("cd") >= 0.5)).alias("oral"),
        share(F.col("zipf") < 4).alias("academico"), share((F.col("zipf") < 3) & ~F.col("is_oov")).alias("dominio"),
        F.avg(surprisal).alias("sorpresa_media"), F.max(surprisal).alias("sorpresa_max"), F.stddev_pop(surprisal).alias("sorpresa_desv"),
    )


def register(oral: Column, academic: Column, domain: Column) -> Column:
    """Register of a unit by its ratios: technical, colloquial, formal, mixed or unknown."""
    return (
        F.when(oral.isNull() & academic.isNull() & domain.isNull(), "desconocido").when(domain > 0.15, "tecnico")
        .when(oral > 0.4, "coloquial").when(academic > 0.3, "formal").otherwise("mixto")
    )


def rarest(scored: DataFrame, unit: str, top: int = 10, term: str = "termino") -> DataFrame:
    """The rarest different words of each unit, least Zipf value first."""
    distinct = scored.select(unit, term, "zipf").distinct()
    rank = F.row_number().over(Window.partitionBy(unit).orderBy("zipf", term))
    return distinct.withColumn("puesto", rank).where(F.col("puesto") <= top)


def adjacent_ngrams(terms: DataFrame, unit: str, n: int = 2, term: str = "termino", patterns: list[tuple[str, ...]] | None = None, pos: str = "pos") -> DataFrame:
    """Joined neighbours of each unit, only those whose word classes are among ``patterns`` if given."""
    window = Window.partitionBy(unit).orderBy("i")
    ahead = terms
    for k in range(1, n):
        ahead = ahead.withColumn(f"_t{k}", F.lead(term, k).over(window))
        if patterns:
            ahead = ahead.withColumn(f"_p{k}", F.lead(pos, k).over(window))
    ahead = ahead.where(F.col(f"_t{n - 1}").isNotNull())
    if patterns:
        joined = F.concat_ws(" ", pos, *(f"_p{k}" for k in range(1, n)))
        ahead = ahead.where(joined.isin([" ".join(p) for p in patterns]))
    return ahead.select(unit, "i", F.concat_ws("_", term, *(f"_t{k}" for k in range(1, n))).alias("ngrama"))


def semantic_diversity(vectors: DataFrame, unit: str, vector: str, sample: int = 500) -> DataFrame:
    """Mean cosine distance between the unit vectors of a unit.

    From the sum s of n unit vectors: the mean of all pairs' cosines is (s.s - n) / (n (n - 1)), so no pair
    is made and no sample is needed.
    """
    dim = vectors.select(F.max(F.size(vector))).first()[0] or 1
    length = F.sqrt(F.aggregate(F.col(vector), F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))
    scaled = vectors.where(F.size(vector) == dim).withColumn("_l", length).where("_l > 0")
    sums = scaled.groupBy(unit).agg(F.count(F.lit(1)).alias("n"), *(F.sum(F.col(vector)[i].cast("double") / F.col("_l")).alias(f"s{i}") for i in range(dim)))
    square = sum((F.col(f"s{i}") * F.col(f"s{i}") for i in range(1, dim)), F.col("s0") * F.col("s0"))
    return sums.where("n > 1").select(unit, "n", (1 - (square - F.col("n")) / (F.col("n") * (F.col("n") - 1))).alias("diversidad"))
