"""Readers of interviews, metadata, lexicons and stored collections."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from tesela.functions.text import source_key
from tesela.operators.tables import IGNORED_SECTIONS

#: Metadata columns of an interview.
METADATA = ("Edad_Cat", "Sexo", "Dependientes_Cat", "Ocupacion_Cat", "Procedencia_Cat")


def metadata(spark: SparkSession, path: str, key: str = "Documento Fuente") -> DataFrame:
    """llave and meta map of a metadata table parted by semicolons."""
    rows = spark.read.csv(path, sep=";", header=True)
    pairs = [x for c in METADATA if c in rows.columns for x in (F.lit(c), F.col(f"`{c}`"))]
    return rows.select(source_key(F.col(f"`{key}`")).alias("llave"), F.create_map(*pairs).alias("meta")).dropDuplicates(["llave"])


def segments(spark: SparkSession, path: str) -> DataFrame:
    """llave, idx, seccion, texto of interview JSON files (output.segmentos); ignored and empty ones left out."""
    schema = "output struct<segmentos:array<struct<seccion_entrevista:string,texto_literal:string>>>"
    files = spark.read.schema(schema).json(path, multiLine=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("archivo"), F.posexplode("output.segmentos").alias("idx", "s"))
    found = files.select(source_key(F.col("archivo")).alias("llave"), "idx", F.col("s.seccion_entrevista").alias("seccion"), F.col("s.texto_literal").alias("texto"))
    return analysed(found, "seccion", "texto")


def analysed(segments: DataFrame, section: str, text: str) -> DataFrame:
    """Segments with a section that is not ignored and a text."""
    return segments.where(F.col(section).isNotNull() & (F.col(section) != "") & ~F.col(section).isin(*IGNORED_SECTIONS) & F.col(text).isNotNull() & (F.col(text) != ""))


def full_texts(spark: SparkSession, path: str) -> DataFrame:
    """llave and texto of whole text files."""
    rows = spark.read.text(path, wholetext=True).withColumn("archivo", F.element_at(F.split(F.input_file_name(), "/"), -1))
    return rows.select(source_key(F.col("archivo")).alias("llave"), F.col("value").alias("texto"))


def interviews(spark: SparkSession, metadata_path: str, segments_path: str, texts_path: str | None = None) -> DataFrame:
    """doc_id (order of the file names), llave, texto, meta, segmentos: one row per interview; a missing text is empty."""
    parts = segments(spark, segments_path)
    docs = parts.groupBy("llave").agg(F.sort_array(F.collect_list(F.struct("idx", "texto", "seccion"))).alias("segmentos"))
    docs = docs.withColumn("doc_id", F.row_number().over(Window.orderBy("llave")) - 1)  # as many rows as files
    docs = docs.join(metadata(spark, metadata_path), "llave", "left")
    if texts_path:
        docs = docs.join(full_texts(spark, texts_path), "llave", "left")
    else:
        docs = docs.withColumn("texto", F.lit(None).cast("string"))
    return docs.select("doc_id", "llave", F.coalesce("texto", F.lit("")).alias("texto"), F.coalesce("meta", F.create_map().cast("map<string,string>")).alias("meta"), "segmentos")


def frequency_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """word, freqcount, subtlwf, zipf, cd of a frequency list with blocks of columns side by side.

    The header row is the first with a cell ``word``; each such cell starts a block of count, frequency per
    million and its logarithm, and a contextual diversity where one is named. zipf = 1 + logarithm; cd over 1 is a
    percentage. A number that cannot be read has the value of an unknown word; of a word given twice the last counts.
    """
    from tesela.operators.lexical import OOV

    lines = spark.read.text(path).withColumn("n", F.monotonically_increasing_id())
    header = lines.where(F.lower("value").rlike("(^|[;,\t])\\s*\"?word\"?\\s*([;,\t]|$)")).orderBy("n").first()
    empty = spark.createDataFrame([], "word string, freqcount double, subtlwf double, zipf double, cd double")
    if header is None:
        return empty
    mark = next(m for m in ";\t," if m in header["value"]) if any(m in header["value"] for m in ";\t,") else ";"
    names = [x.strip().strip('"').lower() for x in header["value"].split(mark)]
    starts = [i for i, x in enumerate(names) if x == "word"]
    cells = lines.where(F.col("n") > header["n"]).select("n", F.split("value", f"\\Q{mark}\\E").alias("c"))
    out = None
    for b, at in enumerate(starts):
        end = starts[b + 1] if b + 1 < len(starts) else len(names)
        cd = next((i for i in range(at, end) if names[i].replace(" ", "") in ("cd", "contextualdiversity", "contextdiversity")), None)
        number = lambda i: F.expr(f"try_cast(replace(trim(c[{i}]), ',', '.') as double)")
        rate = number(cd) if cd is not None else F.lit(None).cast("double")
        block = cells.select("n", F.lit(b).alias("b"), F.trim(F.expr(f"c[{at}]")).alias("word"), number(at + 1).alias("freqcount"), number(at + 2).alias("subtlwf"), (number(at + 3) + 1).alias("zipf"), F.when((rate > 1) & (rate <= 100), rate / 100).otherwise(rate).alias("cd"))
        out = block if out is None else out.unionByName(block)
    kept = out.where("word is not null and word <> ''").fillna({k: v for k, v in OOV.items()})
    return kept.groupBy(F.lower("word").alias("word")).agg(*(F.max_by(c, F.struct("n", "b")).alias(c) for c in ("freqcount", "subtlwf", "zipf", "cd")))


def collection(spark: SparkSession, store: str, name: str, schema: str | None = None) -> DataFrame | None:
    """A stored collection; an empty one of ``schema`` (or None) if it is not there or cannot be read."""
    try:
        return spark.read.parquet(f"{store}/{name}")
    except AnalysisException:
        return spark.createDataFrame([], schema) if schema else None


def unit_id(given, doc, section, place):
    """A unit's id; where it is missing or a UUID, document, section and place joined."""
    uuid = given.rlike("^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$")
    return F.when(given.isNull() | (given == "") | uuid, F.concat_ws("_", doc, section, place)).otherwise(given)


def settings(path: str, default: dict | None = None) -> dict:
    """A small JSON file of settings, for the driver; ``default`` if it is missing or broken."""
    try:
        with open(path, encoding="utf-8") as f:
            return json.load(f)
    except (OSError, ValueError):
        return dict(default or {})


def agents(path: str) -> list[dict]:
    """Agent settings (name, role, instructions, json_schema, few_shot_examples, gram_cats, disc_cats) in the order of their names."""
    found = settings(path)
    return [{"name": k, "gram_cats": [], "disc_cats": [], "few_shot_examples": [], **v} for k, v in sorted(found.items())] if os.path.exists(path) else []


def contextual_diversity(spark: SparkSession, path: str, sep: str = ";") -> DataFrame:
    """word and cd of a table with the columns Word and SUBTLCD (a percentage)."""
    rows = spark.read.csv(path, sep=sep, header=True)
    return rows.select(F.lower("Word").alias("word"), (F.expr("try_cast(SUBTLCD as double)") / 100).alias("cd")).where("word is not null").dropDuplicates(["word"])


def stable_units(units: DataFrame) -> DataFrame:
    """Stable units in the order of documents and places; a missing place is 0."""
    return units.where("is_stable").orderBy("doc_id", F.coalesce("local_idx", F.lit(0)))
