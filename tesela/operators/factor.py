"""Correspondence analysis, supplementary points and term dendrograms."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesela.operators.network import ward, ward_from


def correspondence(counts: DataFrame, label: str, term: str = "termino", value: str = "unidades", n_axes: int = 2, pseudo: float = 0.01, drop_first: bool = False) -> tuple[DataFrame, DataFrame, list[float]]:
    """(row coordinates, column coordinates, inertia of the axes) of the class by term table.

    Rows are the few classes: Spark makes the standardised residuals S as a dense class by term grid and adds up
    S S' (classes x classes), whose eigenvectors the driver finds; columns are projected by a join. With
    ``drop_first`` the first axis is left out. Columns: standard and principal coordinates and contributions.
    """
    spark = counts.sparkSession
    labels = [r[label] for r in counts.select(label).distinct().orderBy(label).collect()]
    if not labels:
        empty = spark.createDataFrame([], "clase string, eje int, principal double, estandar double")
        return empty, empty.withColumnRenamed("clase", term), []
    k = len(labels)
    wide = counts.groupBy(term).agg(*(F.sum(F.when(F.col(label) == x, F.col(value)).otherwise(0)).cast("double").alias(f"r{i}") for i, x in enumerate(labels)))
    filled = wide.select(term, *(F.coalesce(F.col(f"r{i}"), F.lit(0.0)) + pseudo for i in range(k))).toDF(term, *(f"r{i}" for i in range(k)))
    sums = filled.agg(*(F.sum(f"r{i}").alias(f"r{i}") for i in range(k))).first()
    row = np.array([sums[i] for i in range(k)])
    n = row.sum()
    mass = row / n
    column_mass = sum((F.col(f"r{i}") for i in range(1, k)), F.col("r0")) / float(n)
    scored = filled.withColumn("c", column_mass)
    residual = [(F.col(f"r{i}") / float(n) - float(mass[i]) * F.col("c")) / F.sqrt(float(mass[i]) * F.col("c")) for i in range(k)]
    table = scored.select(term, "c", *(x.alias(f"s{i}") for i, x in enumerate(residual)))
    products = [F.sum(F.col(f"s{i}") * F.col(f"s{j}")).alias(f"g{i}_{j}") for i in range(k) for j in range(i, k)]
    got = table.agg(*products).first()
    gram = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            gram[i, j] = gram[j, i] = got[f"g{i}_{j}"]
    values, vectors = np.linalg.eigh(gram)
    order = np.argsort(values)[::-1]
    values, vectors = np.maximum(values[order], 0), vectors[:, order]
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(k)] < 0, -1, 1)
    first = 1 if drop_first else 0
    axes = [a for a in range(first, min(first + n_axes, k - 1)) if values[a] > 1e-12]
    rows = [(labels[i], n_axis, float(vectors[i, a] * np.sqrt(values[a]) / np.sqrt(mass[i])), float(vectors[i, a] / np.sqrt(mass[i])), float(vectors[i, a] ** 2)) for n_axis, a in enumerate(axes) for i in range(k)]
    kind = dict(counts.dtypes)[label]
    row_frame = spark.createDataFrame(rows, f"`{label}` {kind}, eje int, principal double, estandar double, contribucion double")
    each = []
    for n_axis, a in enumerate(axes):
        s = float(np.sqrt(values[a]))
        v = sum((F.col(f"s{i}") * float(vectors[i, a] / s) for i in range(1, k)), F.col("s0") * float(vectors[0, a] / s))
        each.append(F.struct(F.lit(n_axis).alias("eje"), (v * s / F.sqrt("c")).alias("principal"), (v / F.sqrt("c")).alias("estandar"), (v * v).alias("contribucion")))
    if not each:
        return row_frame, table.select(term, F.lit(0).alias("eje"), F.lit(0.0).alias("principal"), F.lit(0.0).alias("estandar"), F.lit(0.0).alias("contribucion")), []
    columns = table.select(term, F.explode(F.array(*each)).alias("x")).select(term, "x.*")
    return row_frame, columns, [float(values[a]) for a in axes]


def supplementary(incidence: DataFrame, columns: DataFrame, unit: str, term: str = "termino") -> DataFrame:
    """Coordinates of units on the axes: the mean standard coordinate of their terms."""
    return incidence.join(columns.select(term, "eje", "estandar"), term).groupBy(unit, "eje").agg(F.avg("estandar").alias("coordenada"))


def multiple_correspondence(incidence: DataFrame, unit: str, term: str = "termino", n_axes: int = 2) -> tuple[DataFrame, DataFrame, list[float]]:
    """Row and column coordinates of the whole unit by term table, and the inertia of the axes.

    The table divided by the roots of its margins has the axes as singular vectors, after a first one that holds
    the margins alone; every term takes part. Columns have principal coordinates; a unit's is the mean of its
    terms' standard ones.
    """
    from tesela.operators.space import leading_vectors

    once = incidence.select(unit, term).distinct()
    total = float(once.count())
    by_unit, by_term = (once.groupBy(c).agg(F.count(F.lit(1)).alias(n)) for c, n in ((unit, "_r"), (term, "_c")))
    if not total or by_term.count() < 2:
        return _no_axes(incidence, unit, term)
    scaled = once.join(by_unit, unit).join(by_term, term).withColumn("_x", 1 / F.sqrt(F.col("_r") * F.col("_c")))
    vectors, sigma = leading_vectors(scaled, unit, term, "_x", n_axes + 1)
    axes = [a for a in range(1, len(sigma)) if sigma[a] > 1e-6]
    # the root of a term's mass turns a singular vector into a standard coordinate
    each = [F.struct(F.lit(n).alias("eje"), (F.col("v")[a] * F.sqrt(total / F.col("_c"))).alias("estandar"), F.lit(float(sigma[a])).alias("_s")) for n, a in enumerate(axes)]
    if not each:
        return _no_axes(incidence, unit, term)
    standard = vectors.join(by_term, term).select(term, F.explode(F.array(*each)).alias("x")).select(term, "x.*").checkpoint()
    rows = once.join(standard, term).groupBy(unit, "eje").agg(F.avg("estandar").alias("coordenada"))
    columns = standard.select(term, "eje", (F.col("estandar") * F.col("_s")).alias("coordenada"))
    return rows, columns, [float(sigma[a] ** 2) for a in axes]


def _no_axes(incidence: DataFrame, unit: str, term: str) -> tuple[DataFrame, DataFrame, list[float]]:
    nothing = incidence.limit(0)
    return tuple(nothing.select(c, F.lit(0).alias("eje"), F.lit(0.0).alias("coordenada")) for c in (unit, term)) + ([],)


def dendrogram(coordinates: DataFrame, term: str = "termino", top: int = 50, by: str = "contribucion") -> list[tuple]:
    """Ward's merges of the ``top`` terms of greatest contribution on their coordinates: (left, right, height, size)."""
    best = coordinates.groupBy(term).agg(F.sum(by).alias("_s")).orderBy(F.desc("_s"), term).limit(top)
    rows = coordinates.join(best, term).groupBy(term).agg(F.sort_array(F.collect_list(F.struct("eje", "estandar"))).alias("x")).orderBy(term).collect()
    points = np.array([[p["estandar"] for p in r["x"]] for r in rows], dtype=float)
    return _named([r[term] for r in rows], ward(points)) if len(rows) > 1 else []


def class_dendrogram(incidence: DataFrame, scored: DataFrame, classes: DataFrame, unit: str, label: str, value, term: str = "termino", top: int = 20) -> list[tuple]:
    """Ward's merges of the ``top`` terms of one class by their profiles over its units.

    The distance of two terms is the sum over units of the squared difference of their column profiles times
    the unit's mass; it needs only the counts of the terms and of their pairs, weighted by mass.
    """
    chosen = scored.where(F.col(label) == value).orderBy(F.desc(F.abs("phi")), term).limit(top).select(term, "phi")
    names = [(r[term], r["phi"]) for r in chosen.collect()]
    index = {t: i for i, (t, _) in enumerate(names)}
    if len(names) < 2:
        return []
    members = classes.where(F.col(label) == value).select(unit)
    kept = incidence.join(members, unit, "left_semi").join(F.broadcast(chosen.select(term)), term)
    sets = kept.groupBy(unit).agg(F.sort_array(F.collect_set(term)).alias("t"))
    pairs = sets.select("t", F.size("t").alias("k"), F.explode("t").alias("a")).select("a", "k", F.explode("t").alias("b"))
    got = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("m")).collect()  # top x top
    p = len(names)
    n, m = np.zeros((p, p)), np.zeros((p, p))
    for r in got:
        n[index[r["a"]], index[r["b"]]], m[index[r["a"]], index[r["b"]]] = r["n"], r["m"]
    total = max(np.trace(n), 1)
    f = np.maximum(np.diag(n), 1)
    own = np.diag(m) / f**2
    squared = np.maximum(own[:, None] + own[None] - 2 * m / np.outer(f, f), 0) / total
    return _named([f"{t} (φ={phi:.2f})" for t, phi in names], ward_from(squared))


def _named(names: list[str], merges: np.ndarray) -> list[tuple]:
    n = len(names)
    name = lambda i: names[i] if i < n else f"#{i - n}"
    return [(name(int(a)), name(int(b)), float(h), int(s)) for a, b, h, s in merges]


def merge_frame(spark: SparkSession, merges: list[tuple]) -> DataFrame:
    return spark.createDataFrame([(i, *m) for i, m in enumerate(merges)], "paso int, izquierda string, derecha string, altura double, n int")
