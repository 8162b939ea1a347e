"""Tables, keys and column expressions that the operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters with the Unicode property White_Space, for a character class of Java or Python.
WHITE_SPACE = "\\x09-\\x0d\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"

#: Name of each text table, its key and its text column.
TEXTS = {
    "corpus": ("doc_id", "texto_completo_txt"),
    "segmentos": ("segmento_id", "texto_literal"),
    "uces": ("uce_id", "texto"),
    "spans": ("span_id", "quote"),
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: Repeated keys of a table that are broadcast, at most; beyond, rows are made distinct by an exchange.
REPEATED_KEYS = 200_000


#: Tasks that a table of few files is spread over, at most: one of more partitions than this stays as it is read.
SPREAD = 16


def spread(df: DataFrame) -> DataFrame:
    """The rows over the session's cores, up to SPREAD, where few and small files are read by fewer tasks."""
    tasks = min(df.sparkSession.sparkContext.defaultParallelism, SPREAD)
    return df.repartition(tasks) if df.rdd.getNumPartitions() < tasks else df


def first_rows(spark: SparkSession, folder: str, name: str, key: str, *columns: str) -> DataFrame:
    """``key`` and ``columns``, one row per key: repeated rows count once, rows without a key are left out.

    The keys alone tell which repeat. Of their rows only the first stays, by file and place in it; up to
    REPEATED_KEYS such keys are broadcast, so that no text or array goes through an exchange.
    """
    every = table(spark, folder, name).where(F.col(key).isNotNull())
    place = F.struct(F.col("_metadata.file_path").alias("f"), F.col("_metadata.row_index").alias("r"))
    repeated = every.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(key).checkpoint()
    if repeated.count() > REPEATED_KEYS:
        return every.select(key, *columns).dropDuplicates([key])
    first = every.select(key, place.alias("_p")).join(F.broadcast(repeated), key).groupBy(key).agg(F.min("_p").alias("_primero"))
    rows = spread(every.select(key, *columns, place.alias("_p"))).join(F.broadcast(first), key, "left")
    return rows.where(F.col("_primero").isNull() | (F.col("_p") == F.col("_primero"))).drop("_p", "_primero")


def distinct_texts(spark: SparkSession, folder: str, *names: str, also: tuple[str, ...] = ()) -> DataFrame:
    """(tabla, clave, texto, *also) of the named tables, one row per key."""
    out = None
    for name in names:
        key, text = TEXTS[name]
        part = first_rows(spark, folder, name, key, text, *also).select(
            F.lit(name).alias("tabla"), F.col(key).cast("string").alias("clave"), F.col(text).alias("texto"), *also
        )
        out = part if out is None else out.unionAll(part)
    return out.where(F.col("texto").isNotNull())


def texts(spark: SparkSession, folder: str, *names: str) -> DataFrame:
    """(tabla, clave, texto) of the named tables, rows without a key or a text left out.

    Repeated rows stay: results are made distinct by key, which moves far fewer bytes than the texts.
    """
    out = None
    for name in names:
        key, text = TEXTS[name]
        part = table(spark, folder, name).select(
            F.lit(name).alias("tabla"), F.col(key).cast("string").alias("clave"), F.col(text).alias("texto")
        )
        out = part if out is None else out.unionAll(part)
    return out.where(F.col("clave").isNotNull() & F.col("texto").isNotNull())


def nfc(value: Column) -> Column:
    """Unicode composition. Latin-1 strings are composed already and skip the call into ICU."""
    composed = F.call_function(
        "reflect", F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), F.coalesce(value, F.lit("")), F.lit(False)
    )
    return F.when(value.rlike("[^\\x{0}-\\x{ff}]"), composed).otherwise(value)


def term(value: Column) -> Column:
    """A value as it is counted: composed, lower case, no blanks and tabs at its ends."""
    return F.btrim(F.lower(nfc(value)), F.lit(" \t"))


def units(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """One row per context unit: repeated rows of ``ucs`` count once, rows without uc_id are left out."""
    return first_rows(spark, folder, "ucs", "uc_id", *columns)


def count_units(spark: SparkSession, folder: str) -> int:
    """N, the number of distinct uc_ids; only the key column is read."""
    return table(spark, folder, "ucs").select("uc_id").where(F.col("uc_id").isNotNull()).distinct().count()
