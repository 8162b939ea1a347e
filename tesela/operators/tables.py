"""The engine's input tables: one row per key, in the shapes that the operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Sections of an interview that are not analysed.
IGNORED_SECTIONS = ("TEXTO_NO_ASIGNADO", "I. Datos sociodemográficos y perfil profesional")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def unique(df: DataFrame, *key: str) -> DataFrame:
    """Rows that repeat a key count once; rows with a null key are left out."""
    for k in key:
        df = df.where(F.col(k).isNotNull())
    return df.dropDuplicates(list(key))


def units(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return unique(table(spark, folder, "uces").select("uce_id", *columns), "uce_id")


def context_units(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return unique(table(spark, folder, "ucs").select("uc_id", *columns), "uc_id")


def corpus(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return unique(table(spark, folder, "corpus").select("doc_id", *columns), "doc_id")


def unit_terms(units: DataFrame, term: str, *keep: str) -> DataFrame:
    """(*keep, i, termino): the values of the array ``term`` with their places; null and blank ones left out."""
    value = F.lower(F.btrim(F.col("valor"), F.lit(" \t")))
    return (
        units.select(*keep, F.posexplode(term).alias("i", "valor"))
        .select(*keep, "i", value.alias("termino"))
        .where("termino is not null and termino <> ''")
    )
