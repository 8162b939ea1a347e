"""A classifier of adverbs by category, trained on template sentences; the lexicon stays the sure way."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, NGram, StringIndexer, Tokenizer, VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesela.operators import lexicon_es as es

#: Sentences in which an adverb of any category can stand.
TEMPLATES = ("Lo hizo {} en la casa", "{} llegó mi hermana", "Eso {} no se sabe", "Vivía {} con su padre", "Dijo {} que vendría", "{}, nadie lo vio", "Trabaja {} desde entonces", "No era {} lo mismo")


def examples(spark: SparkSession) -> DataFrame:
    """oracion, adverbio, categoria: every adverb of the lexicon in every template."""
    rows = [(w, c) for c, ws in es.ADVERBS.items() for w in ws]
    words = spark.createDataFrame(rows, "adverbio string, categoria string").withColumn("plantilla", F.explode(F.array(*map(F.lit, TEMPLATES))))
    return words.select(F.replace("plantilla", F.lit("{}"), F.col("adverbio")).alias("oracion"), "adverbio", "categoria")


def _features() -> list:
    letters = [Tokenizer(inputCol="_l", outputCol="_c"), NGram(n=3, inputCol="_c", outputCol="_g"), HashingTF(inputCol="_g", outputCol="_f1", numFeatures=1024)]
    words = [Tokenizer(inputCol="oracion", outputCol="_w"), HashingTF(inputCol="_w", outputCol="_f2", numFeatures=512)]
    return [*letters, *words, VectorAssembler(inputCols=["_f1", "_f2"], outputCol="features")]


def _spelled(df: DataFrame) -> DataFrame:
    """The adverb letter by letter, with its ends marked."""
    return df.withColumn("_l", F.regexp_replace(F.concat(F.lit("^"), F.lower("adverbio"), F.lit("$")), "(.)", "$1 "))


def train(df: DataFrame, seed: int = 42) -> tuple[PipelineModel, float]:
    """(model, accuracy on one fifth held out by a seeded hash of the sentence). Categories weigh alike."""
    data = _spelled(df)
    shares = data.groupBy("categoria").agg((1.0 / F.count(F.lit(1))).alias("_peso"))
    data = data.join(shares, "categoria").withColumn("_fold", F.pmod(F.xxhash64("oracion", F.lit(seed)), F.lit(5)))
    stages = [StringIndexer(inputCol="categoria", outputCol="label", stringOrderType="alphabetAsc", handleInvalid="keep"), *_features(), LogisticRegression(weightCol="_peso", maxIter=60, regParam=1e-4)]
    model = Pipeline(stages=stages).fit(data.where("_fold > 0"))
    held = model.transform(data.where("_fold = 0")).agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]
    return model, float(held or 0.0)


def classify(df: DataFrame, model: PipelineModel) -> DataFrame:
    """Adds categoria and confianza: the lexicon's with 1, else the model's with its probability."""
    from pyspark.ml.functions import vector_to_array

    labels = model.stages[0].labels
    table = F.broadcast(df.sparkSession.createDataFrame([(w, c) for c, ws in es.ADVERBS.items() for w in ws], "_a string, _lex string").dropDuplicates(["_a"]))
    scored = model.transform(_spelled(df)).withColumn("_p", vector_to_array("probability"))
    names = F.array(*map(F.lit, labels))
    guess = F.element_at(names, F.least(F.col("prediction").cast("int"), F.lit(len(labels) - 1)) + 1)
    joined = scored.join(table, F.lower("adverbio") == F.col("_a"), "left")
    return joined.select(*df.columns, F.coalesce("_lex", guess).alias("categoria"), F.when(F.col("_lex").isNotNull(), 1.0).otherwise(F.array_max("_p")).alias("confianza"))
