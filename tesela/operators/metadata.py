"""Association of classes with metadata, permutation tests, residuals and a forest of predictors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesela.functions.distributions import chi2_sf, f_sf
from tesela.operators.lexical import with_rank


def crosstab(df: DataFrame, row: str, column: str) -> DataFrame:
    """Long contingency table with expected counts and residuals (O - E) / sqrt(max(E, 1e-9)), also where O is 0."""
    known = df.where(F.col(row).isNotNull() & F.col(column).isNotNull())
    cells = known.groupBy(row, column).agg(F.count(F.lit(1)).alias("n"))
    rows = cells.groupBy(row).agg(F.sum("n").alias("nf"))
    columns = cells.groupBy(column).agg(F.sum("n").alias("nc"))
    listed = columns.agg(F.collect_list(F.struct(column, "nc"))).scalar()
    grid = rows.withColumn("l", listed).select(row, "nf", F.explode("l").alias("c")).select(row, "nf", "c.*")
    full = grid.join(cells, [row, column], "left").fillna(0, ["n"]).withColumn("t", cells.agg(F.sum("n")).scalar())
    expected = F.col("nf") * F.col("nc") / F.col("t")
    residual = (F.col("n") - expected) / F.sqrt(F.greatest(expected, F.lit(1e-9)))
    return full.select(row, column, "n", expected.alias("esperado"), residual.alias("residuo"))


def chi2_test(df: DataFrame, label: str, variable: str) -> DataFrame:
    """Chi-square without correction, degrees of freedom, p and Cramer's V of a class and a category, in one row."""
    table = crosstab(df, label, variable)
    stats = table.agg(
        F.sum(F.pow(F.col("n") - F.col("esperado"), 2) / F.greatest("esperado", F.lit(1e-9))).alias("chi2"), F.sum("n").alias("n"),
        F.countDistinct(label).alias("r"), F.countDistinct(variable).alias("c"),
    ).where("r > 1 and c > 1")
    df_ = (F.col("r") - 1) * (F.col("c") - 1)
    return stats.select(
        F.lit(variable).alias("variable"), "chi2", df_.alias("gl"), "n", F.sqrt(F.col("chi2") / (F.col("n") * (F.least("r", "c") - 1))).alias("v")
    ).withColumn("p", chi2_sf(F.col("chi2"), F.col("gl").cast("double")))


def anova(df: DataFrame, label: str, variable: str) -> DataFrame:
    """One-way analysis of variance of a number by class: F, p, eta squared; no row if a group has under two values."""
    known = df.where(F.col(label).isNotNull() & F.col(variable).isNotNull())
    groups = known.groupBy(label).agg(F.count(F.lit(1)).alias("n"), F.avg(variable).alias("m"), F.var_samp(variable).alias("v"))
    total = groups.agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"), F.min("n").alias("menor"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("media"),
        F.sum(F.col("n") * F.col("m") * F.col("m")).alias("q"), F.sum((F.col("n") - 1) * F.col("v")).alias("dentro"),
    ).where("k > 1 and menor > 1")
    between = F.col("q") - F.col("n") * F.col("media") * F.col("media")
    f = (between / (F.col("k") - 1)) / (F.col("dentro") / (F.col("n") - F.col("k")))
    return total.select(
        F.lit(variable).alias("variable"), (F.col("k") - 1).alias("gl_1"), (F.col("n") - F.col("k")).alias("gl_2"), f.alias("f"), (between / (between + F.col("dentro"))).alias("eta2")
    ).withColumn("p", f_sf(F.col("f"), F.col("gl_1"), F.col("gl_2")))


def permutation_test(df: DataFrame, unit: str, label: str, variable: str, rounds: int = 100, seed: int = 42) -> DataFrame:
    """p = (rounds with a chi-square of at least the observed one, plus 1) / (rounds + 1), labels dealt anew by a seeded hash."""
    known = df.where(F.col(label).isNotNull() & F.col(variable).isNotNull()).select(unit, label, variable)
    dealt = known.withColumn("vuelta", F.explode(F.sequence(F.lit(0), F.lit(rounds))))
    window = Window.partitionBy("vuelta")  # of cells, not of units
    # round 0 keeps the order: the observed table
    shuffled = F.when(F.col("vuelta") == 0, 0).otherwise(F.xxhash64(unit, "vuelta", F.lit(seed)))
    places = with_rank(dealt, [shuffled, F.col(unit)], "n", by="vuelta").select("vuelta", variable, "n")
    labels = with_rank(dealt, [F.col(unit)], "n", by="vuelta").select("vuelta", label, "n")
    cells = places.join(labels, ["vuelta", "n"]).groupBy("vuelta", label, variable).agg(F.count(F.lit(1)).alias("o"))
    nr = F.sum("o").over(Window.partitionBy("vuelta", label))
    nc = F.sum("o").over(Window.partitionBy("vuelta", variable))
    nt = F.sum("o").over(window)
    # chi-square = N (sum of o^2 / (row x column)) - N: cells of no units add nothing
    stats = cells.withColumn("x", F.col("o") * F.col("o") / (nr * nc)).withColumn("t", nt).groupBy("vuelta").agg((F.first("t") * F.sum("x") - F.first("t")).alias("chi2"))
    observed = stats.where("vuelta = 0").select("chi2").scalar()
    return stats.where("vuelta > 0").withColumn("obs", observed).groupBy("obs").agg(((F.count_if(F.col("chi2") >= F.col("obs") - 1e-9) + 1) / (F.count(F.lit(1)) + 1)).alias("p")).select(F.col("obs").alias("chi2"), "p")


def without_outliers(df: DataFrame, column: str, method: str = "iqr") -> DataFrame:
    """Rows within 1.5 interquartile ranges (or 3 deviations) of a number; all rows if fewer than half, or ten, would stay."""
    if method == "iqr":
        low, high = df.approxQuantile(column, [0.25, 0.75], 0.0) or (0.0, 0.0)
        inside = F.col(column).between(low - 1.5 * (high - low), high + 1.5 * (high - low))
    else:
        mean, deviation = df.agg(F.avg(column), F.stddev_samp(column)).first()
        inside = F.abs(F.col(column) - (mean or 0.0)) <= 3 * (deviation or 0.0)
    kept, every = df.where(inside | F.col(column).isNull()), df.count()
    return kept if kept.count() >= max(10, every / 2) else df


def forest(df: DataFrame, label: str, categories: list[str], numbers: list[str] = (), trees: int = 50, depth: int = 8, folds: int = 3, seed: int = 42, max_levels: int = 20, key: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(importance by variable, confusion of held-out predictions) of a random forest that predicts the class.

    Missing categories become a level, missing numbers the median; a category of more than ``max_levels`` levels
    goes in by its frequency. Rows are dealt to the folds by a seeded hash of ``key``, or of all their values, and each
    is told by a forest of the other folds: ``exactitud_equilibrada`` is the mean recall of the classes over all.
    Permutation importance is the loss of accuracy in the first fold when a variable's values are dealt anew.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import Imputer, OneHotEncoder, StringIndexer, VectorAssembler

    spark = df.sparkSession
    data = df.where(F.col(label).isNotNull()).select(F.col(label).cast("string").alias("_y"), *(F.coalesce(F.col(c).cast("string"), F.lit("(falta)")).alias(c) for c in categories), *(F.col(c).cast("double").alias(c) for c in numbers), F.xxhash64(*([key] if key else df.columns)).alias("_id"))
    data = StringIndexer(inputCol="_y", outputCol="_l", stringOrderType="alphabetAsc", handleInvalid="keep").fit(data).transform(data)  # the same numbers in every fold
    stages, inputs, frequent = [], [], []
    for c in categories:
        if data.select(c).distinct().count() > max_levels:
            shares = data.groupBy(c).agg(F.count(F.lit(1)).cast("double").alias(f"{c}_f"))
            data = data.join(shares, c).drop(c).withColumnRenamed(f"{c}_f", c)
            frequent.append(c)
        else:
            stages += [StringIndexer(inputCol=c, outputCol=f"{c}_i", handleInvalid="keep"), OneHotEncoder(inputCol=f"{c}_i", outputCol=f"{c}_v", dropLast=True)]
            inputs.append(f"{c}_v")
    plain = [*numbers, *frequent]
    if plain:
        stages.append(Imputer(inputCols=plain, outputCols=[f"{c}_m" for c in plain], strategy="median"))
        inputs += [f"{c}_m" for c in plain]
    stages += [VectorAssembler(inputCols=inputs, outputCol="features"), RandomForestClassifier(labelCol="_l", featuresCol="features", numTrees=trees, maxDepth=depth, seed=seed)]
    data = data.withColumn("_fold", F.pmod(F.xxhash64("_id", F.lit(seed)), F.lit(folds))).checkpoint()
    held, model, test = None, None, data.where("_fold = 0")
    for fold in range(max(1, folds)):  # every row is told by a forest that has not seen it
        fitted = Pipeline(stages=stages).fit(data.where(F.col("_fold") != fold) if folds > 1 else data)
        told = fitted.transform(data.where(F.col("_fold") == fold)).select("_l", "prediction")
        held, model = (told, fitted) if held is None else (held.unionByName(told), model)
    held = held.checkpoint()
    right = (F.col("prediction") == F.col("_l")).cast("double")
    balanced = held.groupBy("_l").agg(F.avg(right).alias("r")).agg(F.avg("r")).first()[0] or 0.0  # mean recall of the classes
    base = model.transform(test).agg(F.avg(right)).first()[0] or 0.0
    rows = []
    for c in [*categories, *numbers]:
        keyed = with_rank(test.withColumn("_h", F.xxhash64("_id", F.lit(seed + 1))), [F.col("_h"), F.col("_id")], "_k").drop("_h")
        donor = with_rank(test.select(F.col(c).alias("_v"), "_id", F.xxhash64("_id", F.lit(seed + 2)).alias("_h")), [F.col("_h"), F.col("_id")], "_k").drop("_h", "_id")
        dealt = keyed.join(donor, "_k").drop(c, "_k").withColumnRenamed("_v", c)
        loss = model.transform(dealt).agg(F.avg((F.col("prediction") == F.col("_l")).cast("double"))).first()[0] or 0.0
        rows.append((c, float(base - loss), float(base), float(balanced)))
    importance = spark.createDataFrame(rows, "variable string, importancia double, exactitud double, exactitud_equilibrada double")
    confusion = held.groupBy("_l", "prediction").agg(F.count(F.lit(1)).alias("n"))
    return importance, confusion


def shapley(values: dict[frozenset, float], players: list[str]) -> dict[str, float]:
    """Exact Shapley values of at most six variables from the worth of every subset."""
    from itertools import combinations
    from math import factorial

    n, out = len(players), {}
    for p in players:
        others = [q for q in players if q != p]
        out[p] = sum(
            factorial(k) * factorial(n - k - 1) / factorial(n) * (values[frozenset((*s, p))] - values[frozenset(s)]) for k in range(n) for s in combinations(others, k)
        )
    return out


def entropy_by(df: DataFrame, feature: str, value: str) -> DataFrame:
    """Entropy in nats, levels, size and the three most frequent values of each feature."""
    counts = df.where(F.col(value).isNotNull()).groupBy(feature, value).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(feature))
    rank = F.row_number().over(Window.partitionBy(feature).orderBy(F.desc("n"), value))
    scored = counts.withColumn("p", F.col("n") / total).withColumn("r", rank)
    top = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("r") <= 3, F.struct("r", F.col(value).cast("string").alias("v"))))), lambda x: x.v), ", ")
    return scored.groupBy(feature).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("niveles"), (-F.sum(F.col("p") * F.ln("p"))).alias("entropia"), top.alias("principales"))


def profile(df: DataFrame, first: str, second: str) -> DataFrame:
    """Counts by two categories apart, in one pass: grouping sets."""
    df.createOrReplaceTempView("_perfil")
    return df.sparkSession.sql(f"select {first}, {second}, count(*) as n from _perfil group by grouping sets (({first}), ({second}))")


def described(df: DataFrame, *columns: str) -> DataFrame:
    """Count, mean, sample deviation, least, quartiles and greatest of numbers, one row each."""
    parts = [
        df.select(F.lit(c).alias("variable"), F.col(c).cast("double").alias("x")) for c in columns
    ]
    long = parts[0]
    for p in parts[1:]:
        long = long.unionAll(p)
    q: Column = F.percentile("x", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    got = long.groupBy("variable").agg(F.count("x").alias("n"), F.avg("x").alias("media"), F.stddev_samp("x").alias("desv"), F.min("x").alias("minimo"), q.alias("q"), F.max("x").alias("maximo"))
    return got.select("variable", "n", "media", "desv", "minimo", F.col("q")[0].alias("q1"), F.col("q")[1].alias("mediana"), F.col("q")[2].alias("q3"), "maximo")


def alternation(events: DataFrame, who: str, order: list[str], state: str) -> DataFrame:
    """Changes of state per sequence, their rate over n - 1, and the most frequent state (ties: the least)."""
    window = Window.partitionBy(who).orderBy(*order)
    flagged = events.where(F.col(state).isNotNull()).withColumn("_b", F.lag(state).over(window))
    changed = (F.col("_b").isNotNull() & (F.col("_b") != F.col(state))).cast("int")
    counts = flagged.groupBy(who, state).agg(F.count(F.lit(1)).alias("c"), F.sum(changed).alias("k"))
    return counts.groupBy(who).agg(F.sum("c").alias("n"), F.sum("k").alias("cambios"), F.min_by(state, F.struct(-F.col("c"), F.col(state))).alias("modal")).withColumn(
        "tasa", F.when(F.col("n") > 1, F.col("cambios") / (F.col("n") - 1)).otherwise(0.0)
    )


def transitions(events: DataFrame, who: str, order: list[str], state: str) -> DataFrame:
    """Counts of changes from one state to another; staying is none."""
    window = Window.partitionBy(who).orderBy(*order)
    return events.where(F.col(state).isNotNull()).withColumn("desde", F.lag(state).over(window)).where(F.col("desde") != F.col(state)).groupBy("desde", F.col(state).alias("hasta")).agg(F.count(F.lit(1)).alias("n"))
