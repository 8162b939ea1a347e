"""Problem 2: frequency of every value. Problem 3: how distinctive a value is per record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesela.llm.common import term


#: Terms whose statistics are broadcast to their records, at most; beyond, they are joined by an exchange.
BROADCAST_TERMS = 500_000


def tallies(records: DataFrame, key: str, *columns: str) -> DataFrame:
    """``key`` and for each array column ``c`` of it ``c`` (array of (termino, tf)) and ``c_largo`` (values in all).

    Values are sorted within their row and runs of equal ones are counted there: no exchange, and no work
    beyond n log n for a very long array. Null and blank values are none; a null array has none.
    """
    def ordered(column: str) -> Column:
        values = F.transform(F.coalesce(F.col(column), F.array().cast("array<string>")), term)
        return F.sort_array(F.filter(values, lambda v: v != ""))

    def starts(values: Column) -> Column:
        return F.filter(F.transform(values, lambda v, i: F.when((i == 0) | (v != F.get(values, i - 1)), i)), lambda i: i.isNotNull())

    def runs(values: Column, begin: Column) -> Column:
        return F.transform(begin, lambda i, k: F.struct(F.get(values, i).alias("termino"), (F.coalesce(F.get(begin, k + 1), F.size(values)) - i).cast("long").alias("tf")))

    ready = records.select(key, *(ordered(c).alias(c) for c in columns))
    cut = ready.select(key, *columns, *(starts(F.col(c)).alias(f"_{c}") for c in columns))
    return cut.select(key, *(runs(F.col(c), F.col(f"_{c}")).alias(c) for c in columns), *(F.size(c).cast("long").alias(f"{c}_largo") for c in columns))


def record_terms(records: DataFrame, key: str, *columns: str) -> DataFrame:
    """(key, campo, termino, tf, largo): how often each value occurs in each record, and the values of the record.

    Null and blank values are none; a null or empty array has no rows. ``records`` must hold each key once.
    """
    def named(column: str) -> Column:
        return F.transform(column, lambda v: F.struct(F.lit(column).alias("campo"), v.termino.alias("termino"), v.tf.alias("tf"), F.col(f"{column}_largo").alias("largo")))

    counted = tallies(records, key, *columns)
    values = F.concat(*map(named, columns))
    return counted.select(key, F.explode(values).alias("v")).select(key, "v.*")


def term_frequencies(counts: DataFrame, n_records: int, rare_below: int = 3, common_tenths: int = 3) -> DataFrame:
    """Occurrences and records of every (campo, termino) of :func:`record_terms`, with a mark.

    ``marca`` is ``raro`` in fewer than ``rare_below`` records, else ``comun`` in at least
    ``common_tenths`` of ten records, else null. Counts are combined by hash in each partition before
    the exchange, so a value held by a third of the records costs one row per partition.
    """
    mark = F.when(F.col("unidades") < rare_below, "raro").when(
        F.col("unidades") * 10 >= common_tenths * F.lit(n_records), "comun"
    )
    return (
        counts.groupBy("campo", "termino")
        .agg(F.sum("tf").alias("apariciones"), F.count(F.lit(1)).alias("unidades"))
        .withColumn("marca", mark)
    )


def divergence_scores(counts: DataFrame, key: str, n_records: int) -> DataFrame:
    """Divergence from randomness of every term of every record (geometric model, Laplace gain).

    With F occurrences over N records, lambda = F / N, and the length-normalised frequency
    tfn = tf log2(1 + mean length / length):

        score = (log2(1 + lambda) + tfn log2((1 + lambda) / lambda)) / (tfn + 1)

    The mean length is over all ``n_records``. ``counts`` holds (key, campo, termino, tf, largo) as it comes from
    :func:`record_terms`. Adds unidades (records with the term), apariciones and ``puntaje``. The statistics of a
    term, summed in each partition first, come back by a join on it: those of up to BROADCAST_TERMS terms are
    broadcast, so that the records stay where they are; more are joined by an exchange, in which AQE splits a
    term held by a third of all records.
    """
    stats = (
        counts.groupBy("campo", "termino")
        .agg(F.sum("tf").alias("apariciones"), F.count(F.lit(1)).alias("unidades"))
        .checkpoint()
    )
    means = {r["campo"]: r["t"] / n_records for r in stats.groupBy("campo").agg(F.sum("apariciones").alias("t")).collect()}  # one row per campo
    mean = F.create_map(*(F.lit(x) for kv in means.items() for x in kv))[F.col("campo")] if means else F.lit(None).cast("double")
    small = stats.count() <= BROADCAST_TERMS
    joined = counts.join(F.broadcast(stats) if small else stats, ["campo", "termino"])
    lam = F.col("apariciones") / F.lit(float(n_records))
    tfn = F.col("tf") * F.log2(1 + mean / F.col("largo"))
    return joined.withColumn("tfn", tfn).select(
        key,
        "campo",
        "termino",
        "tf",
        "apariciones",
        "unidades",
        ((F.log2(1 + lam) + F.col("tfn") * F.log2((1 + lam) / lam)) / (F.col("tfn") + 1)).alias("puntaje"),
    )
