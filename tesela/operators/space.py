"""Classes in embedding space: centroids, distances, soft membership, trajectories, retrofitting."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesela.functions.vectors import cosine, mean_vector, usable


def class_centroids(units: DataFrame, label: str, vector: str, dim: int, weight: str | None = None) -> DataFrame:
    """Mean vector and size of each class; with ``weight`` the weighted mean. Unusable vectors are left out."""
    known = units.where(F.col(label).isNotNull() & (F.col(label) != -1) & usable(vector, dim))
    if weight is None:
        return known.groupBy(label).agg(F.count(F.lit(1)).alias("n"), mean_vector(vector, dim).alias("centroide"))
    sums = [F.sum(F.col(vector)[i].cast("double") * F.col(weight)).alias(f"s{i}") for i in range(dim)]
    got = known.groupBy(label).agg(F.count(F.lit(1)).alias("n"), F.sum(weight).alias("w"), *sums)
    return got.select(label, "n", F.array(*(F.col(f"s{i}") / F.col("w") for i in range(dim))).alias("centroide"))


def class_distances(centroids: DataFrame, label: str) -> DataFrame:
    """Cosine distance of every two classes; their number is small, and they are paired through one list."""
    listed = centroids.agg(F.collect_list(F.struct(F.col(label).alias("clase_2"), F.col("centroide").alias("c2")))).scalar()
    pairs = centroids.withColumn("l", listed).select(F.col(label).alias("clase_1"), "centroide", F.explode("l").alias("o"))
    return pairs.select("clase_1", "o.clase_2", F.when(F.col("clase_1") == F.col("o.clase_2"), 0.0).otherwise(1 - cosine(F.col("centroide"), F.col("o.c2"))).alias("distancia"))


def soft_membership(units: DataFrame, centroids: DataFrame, unit: str, label: str, vector: str, dim: int, temperature: float = 0.1) -> DataFrame:
    """unit, clase, pertenencia: softmax over classes of cosine / temperature.

    The centroids are as many as classes and go to every task; a batch of units is one matrix product.
    """
    known = [(r[label], r["centroide"]) for r in centroids.orderBy(label).collect()]
    names = np.array([k for k, _ in known], dtype=np.int32)
    means = np.array([c for _, c in known], dtype=float).reshape(-1, dim)
    means = means / np.maximum(np.linalg.norm(means, axis=1, keepdims=True), 1e-300)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(batch.column(1).flatten().cast(pa.float64())).reshape(-1, dim)
            score = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ means.T / temperature
            score = np.exp(score - score.max(axis=1, keepdims=True))
            share = score / score.sum(axis=1, keepdims=True)
            keys = batch.column(0).take(pa.array(np.repeat(np.arange(len(x)), len(names))))
            yield pa.RecordBatch.from_arrays([keys, pa.array(np.tile(names, len(x))), pa.array(share.ravel())], [unit, "clase", "pertenencia"])

    kind = dict(units.dtypes)[unit]
    schema = f"`{unit}` {kind}, clase int, pertenencia double"
    if not len(names):
        return units.sparkSession.createDataFrame([], schema)
    return units.where(usable(vector, dim)).select(unit, vector).mapInArrow(run, schema)


def liminal(membership: DataFrame, unit: str) -> DataFrame:
    """Entropy and dominant class of each unit; liminal if the entropy is over median + median deviation."""
    per = membership.groupBy(unit).agg(
        (-F.sum(F.col("pertenencia") * F.ln(F.col("pertenencia") + 1e-12))).alias("entropia"),
        F.max_by("clase", F.struct("pertenencia", -F.col("clase"))).alias("dominante"),
    )
    per = per.checkpoint()
    centred = per.withColumn("m", per.agg(F.percentile("entropia", F.lit(0.5))).scalar())
    spread = centred.agg(F.percentile(F.abs(F.col("entropia") - F.col("m")), F.lit(0.5))).scalar()
    return centred.withColumn("d", spread).select(unit, "entropia", "dominante", (F.col("entropia") > F.col("m") + F.col("d")).alias("liminal"))


def trajectory(units: DataFrame, doc: str, order: str, label: str) -> DataFrame:
    """Adds cambio: whether the class differs from the unit's before, 0 for the first."""
    from tesela.operators.segmentation import document_windows, own_rows

    rows, window = document_windows(units, doc, order)
    changed = (~F.col(label).eqNullSafe(F.lag(label).over(window))).cast("int") * F.lag(order).over(window).isNotNull().cast("int")
    return own_rows(rows.withColumn("cambio", F.coalesce(changed, F.lit(0))))


def latent_vocabulary(lexicon: DataFrame, used: DataFrame, centroids: DataFrame, label: str, top: int = 20) -> DataFrame:
    """Lexicon words the corpus lacks that lie near a class: cosine x max(0, 1 - |ln(cd + 1e-6)|), the best of each class."""
    absent = lexicon.join(used.select(F.col("termino").alias("word")), "word", "left_anti")
    listed = centroids.agg(F.collect_list(F.struct(F.col(label).alias("clase"), F.col("centroide").alias("c")))).scalar()
    pairs = absent.withColumn("l", listed).select("word", "vec", "cd", F.explode("l").alias("k"))
    score = cosine(F.col("vec"), F.col("k.c")) * F.greatest(F.lit(0.0), 1 - F.abs(F.ln(F.col("cd") + 1e-6)))
    rank = F.row_number().over(Window.partitionBy("clase").orderBy(F.desc("puntaje"), "word"))
    return pairs.select(F.col("k.clase").alias("clase"), "word", score.alias("puntaje")).withColumn("puesto", rank).where(F.col("puesto") <= top)


def constraint_graph(scored: DataFrame, label: str, term: str = "termino", top: int = 50) -> DataFrame:
    """Edges between the ``top`` significant positive terms of a class, weight the lesser chi-square; the greatest over classes."""
    rank = F.row_number().over(Window.partitionBy(label).orderBy(F.desc("chi2_yates"), term))
    good = scored.where("significativo and phi > 0").withColumn("r", rank).where(F.col("r") <= top)
    lists = good.groupBy(label).agg(F.sort_array(F.collect_list(F.struct(F.col(term).alias("t"), F.col("chi2_yates").alias("x")))).alias("l"))
    pairs = lists.select("l", F.posexplode("l").alias("i", "p")).select("p", F.explode(F.slice("l", F.col("i") + 2, F.size("l"))).alias("q"))
    return pairs.groupBy(F.col("p.t").alias("a"), F.col("q.t").alias("b")).agg(F.max(F.least("p.x", "q.x")).alias("peso"))


def retrofit(vectors: DataFrame, edges: DataFrame, dim: int, alpha: float = 1.0, beta: float = 1.0, rounds: int = 10, corpus: DataFrame | None = None, gamma: float = 0.0) -> DataFrame:
    """word, vec: vectors drawn towards those of their neighbours, (alpha v + gamma c + beta sum w q) / (alpha + gamma + beta sum w).

    Jacobi rounds, one join each, written to the checkpoint folder every third; the fixed point is that of
    word-by-word updates.
    """
    both = edges.select("a", "b", "peso").union(edges.select("b", "a", "peso"))
    base = vectors.select("word", F.col("vec").alias("v"))
    if corpus is not None:
        base = base.join(corpus.select("word", F.col("vec").alias("c")), "word", "left")
    else:
        base = base.withColumn("c", F.lit(None).cast("array<double>"))
    current = vectors.select("word", "vec")
    for step in range(rounds):
        sums = [F.sum(F.col("peso") * F.col("vec")[i].cast("double")).alias(f"s{i}") for i in range(dim)]
        near = both.join(current, both.b == current.word).groupBy("a").agg(F.sum("peso").alias("w"), *sums)
        near = near.select("a", "w", F.array(*(f"s{i}" for i in range(dim))).alias("s"))
        joined = base.join(near, base.word == near.a, "left")
        g = F.when(F.col("c").isNotNull(), gamma).otherwise(0.0)
        scale = alpha + g + beta * F.coalesce("w", F.lit(0.0))
        zero = F.array(*[F.lit(0.0)] * dim)
        new = F.zip_with(
            F.zip_with("v", F.coalesce("c", zero), lambda x, y: x.cast("double") * alpha + y * gamma), F.coalesce("s", zero), lambda x, y: x + y * beta
        )
        current = joined.select("word", F.transform(new, lambda x: x / scale).alias("vec"))
        if step % 3 == 2:
            current = current.checkpoint()
    return current


def ppmi(incidence: DataFrame, unit: str, term: str = "termino", background: DataFrame | None = None, k: float = 1.0) -> DataFrame:
    """unit, term, ppmi = max(0, ln(P(unit, term) / (P(unit) P(term))) - ln k), P(term) from ``background`` (term, p) if given.

    The background is scaled to sum to 1 over the vocabulary; a term it lacks has its share in the corpus.
    """
    total = incidence.agg(F.count(F.lit(1))).scalar()
    by_unit = incidence.groupBy(unit).agg(F.count(F.lit(1)).alias("nu"))
    by_term = incidence.groupBy(term).agg(F.count(F.lit(1)).alias("nt")).withColumn("t", total).withColumn("p", F.col("nt") / F.col("t"))
    if background is not None:
        known = by_term.drop("p").join(background.select(term, F.col("p").alias("pb")), term, "left").withColumn("pb", F.coalesce("pb", F.col("nt") / F.col("t")))
        whole = known.agg(F.sum("pb")).scalar()
        by_term = known.withColumn("sp", whole).select(term, "t", (F.col("pb") / F.col("sp")).alias("p"))
    joined = incidence.join(by_unit, unit).join(by_term.select(term, "t", "p"), term)
    value = F.ln((1 / F.col("t")) / (F.col("nu") / F.col("t") * F.col("p"))) - F.ln(F.lit(float(k)))
    return joined.select(unit, term, F.greatest(F.lit(0.0), value).alias("ppmi"))


def weighted_unit_vectors(tokens: DataFrame, vectors: DataFrame, unit: str, dim: int, weight: str | None = None) -> DataFrame:
    """L2-normalised weighted mean of the word vectors of each unit; words without a vector are left out."""
    w = F.col(weight) if weight else F.lit(1.0)
    joined = tokens.join(vectors, tokens.termino == vectors.word).withColumn("_w", w)
    sums = [F.sum(F.col("vec")[i].cast("double") * F.col("_w")).alias(f"s{i}") for i in range(dim)]
    got = joined.groupBy(unit).agg(F.sum("_w").alias("w"), *sums).where("w > 0")
    raw = F.array(*(F.col(f"s{i}") / F.col("w") for i in range(dim)))
    length = F.sqrt(F.aggregate("m", F.lit(0.0), lambda s, x: s + x * x))
    return got.select(unit, raw.alias("m")).withColumn("l", length).select(unit, F.when(F.col("l") > 0, F.transform("m", lambda x: x / F.col("l"))).otherwise(F.col("m")).alias("vec"))


def cd_weight(cd, is_oov=None):
    """Inverse of contextual diversity; 1 for an unknown word."""
    plain = 1 / (cd + 1e-6)
    return plain if is_oov is None else F.when(is_oov, 1.0).otherwise(plain)


#: Terms whose vectors the driver holds and broadcasts, at most; beyond, they stay in Spark and are joined by an exchange.
BROADCAST_VECTORS = 100_000


def _held_vectors(cells: DataFrame, names: list[str], dim: int, k: int, rounds: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Leading right singular vectors of (u, t, x) for a bounded number of terms, and the singular values.

    A unit's cells come together once; in each round every task multiplies its units by the vectors and their
    transpose and sends one row for each term it met.
    """
    spark = cells.sparkSession
    rows = cells.groupBy("u").agg(F.collect_list(F.struct("t", "x")).alias("c")).select("c").checkpoint()
    words = spark.sparkContext.broadcast(names)
    v = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(names), k)))[0]
    last, z = np.zeros(k), v
    for _ in range(rounds):
        held = spark.sparkContext.broadcast(v)

        def through(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            own, index = held.value, pa.array(words.value, pa.string())
            total, met = np.zeros(own.shape), np.zeros(len(own), dtype=bool)
            for batch in batches:
                lists = batch.column(0)
                flat = lists.flatten()
                j = np.asarray(pc.index_in(flat.field("t"), value_set=index))
                x = np.asarray(flat.field("x"))[:, None]
                size = np.asarray(lists.value_lengths())
                if not len(j):
                    continue
                starts = np.concatenate([[0], np.cumsum(size[size > 0])[:-1]])
                y = np.add.reduceat(x * own[j], starts, axis=0)
                part = x * np.repeat(y, size[size > 0], axis=0)
                order = np.argsort(j, kind="stable")
                which, first = np.unique(j[order], return_index=True)
                total[which] += np.add.reduceat(part[order], first, axis=0)
                met[which] = True
            at = np.flatnonzero(met)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(list(total[at]), pa.list_(pa.float64()))], ["j", "z"])

        sums = rows.mapInArrow(through, "j long, z array<double>").groupBy("j").agg(*(F.sum(F.col("z")[i]).alias(f"z{i}") for i in range(k)))
        got = sums.toArrow()  # a row per term
        z = np.zeros(v.shape)
        z[np.asarray(got.column("j"))] = np.column_stack([np.asarray(got.column(f"z{i}")) for i in range(k)])
        held.unpersist()
        values, axes = np.linalg.eigh((v.T @ z + z.T @ v) / 2)
        now = np.sqrt(np.maximum(values[::-1], 0))
        basis, v = v @ axes[:, ::-1], np.linalg.qr(z)[0]
        if np.abs(now[:dim] - last[:dim]).max() <= 1e-6 * max(now[0], 1e-300):
            break
        last = now
    basis = basis[:, :dim] * np.where(basis[np.abs(basis).argmax(axis=0), np.arange(k)] < 0, -1.0, 1.0)[:dim]
    return basis, now[:dim]


def leading_vectors(weights: DataFrame, unit: str, term: str, value: str, dim: int, rounds: int = 30, extra: int = 8, seed: int = 42, held: int = BROADCAST_VECTORS) -> tuple[DataFrame, np.ndarray]:
    """((term, v), singular values): the leading right singular vectors of a sparse unit by term table of any size.

    Subspace iteration: ``dim`` + ``extra`` seeded vectors are multiplied by the table and its transpose and made
    orthonormal, until no singular value moves by a millionth. Up to ``held`` terms the driver holds the vectors;
    for more they stay in Spark: two joins a round, written to the checkpoint folder, and (dim + extra) squared
    products for the driver. Signs make the largest component positive. Every term has a vector.
    """
    cells = weights.select(F.col(unit).alias("u"), F.col(term).alias("t"), F.col(value).cast("double").alias("x")).where("x <> 0").checkpoint()
    terms = cells.select("t").distinct()
    n = terms.count()
    k = min(n, dim + extra)
    if k == 0:
        return terms.select(F.col("t").alias(term), F.array().cast("array<double>").alias("v")), np.zeros(0)
    if n <= held:
        names = sorted(r["t"] for r in terms.collect())  # at most ``held`` rows
        basis, sigma = _held_vectors(cells, names, min(dim, k), k, rounds, seed)
        rows = [(w, [float(x) for x in v]) for w, v in zip(names, basis)]
        return weights.sparkSession.createDataFrame(rows, f"`{term}` string, v array<double>"), sigma
    start = (F.pmod(F.xxhash64("t", F.lit(seed), F.lit(i)), F.lit(1 << 30)) / float(1 << 29) - 1 for i in range(k))
    vectors = terms.select("t", F.array(*start).alias("v"))
    list_of = lambda prefix: F.array(*(F.col(f"{prefix}{i}") for i in range(k)))

    def times(table: DataFrame, on: str, column: str, by: str) -> DataFrame:
        sums = (F.sum(F.col("x") * F.col(column)[i]).alias(f"s{i}") for i in range(k))
        return table.groupBy(by).agg(*sums).select(by, list_of("s").alias("v"))

    def products(rows: DataFrame) -> np.ndarray:
        got = rows.agg(*(F.sum(F.col("v")[i] * F.col("v")[j]).alias(f"g{i}_{j}") for i in range(k) for j in range(i, k))).first()
        out = np.zeros((k, k))
        for i in range(k):
            for j in range(i, k):
                out[i, j] = out[j, i] = got[f"g{i}_{j}"]
        return out

    def turned(rows: DataFrame, matrix: np.ndarray) -> DataFrame:
        mixed = (sum((F.col("v")[i] * float(matrix[i, j]) for i in range(1, k)), F.col("v")[0] * float(matrix[0, j])) for j in range(matrix.shape[1]))
        return rows.select("t", F.array(*mixed).alias("v"))

    def orthonormal(rows: DataFrame, gram: np.ndarray) -> DataFrame:
        values, axes = np.linalg.eigh(gram)
        return turned(rows, axes[:, ::-1] / np.sqrt(np.maximum(values[::-1], 1e-300)))

    vectors = orthonormal(vectors, products(vectors)).checkpoint()
    last = np.zeros(k)
    for _ in range(rounds):
        by_unit = times(cells.join(vectors, "t"), "t", "v", "u")
        through = times(cells.join(by_unit, "u"), "u", "v", "t").checkpoint()
        gram = products(through)
        vectors = orthonormal(through, gram).checkpoint()
        now = np.sqrt(np.sqrt(np.maximum(np.linalg.eigvalsh(gram)[::-1], 0)))
        if np.abs(now[:dim] - last[:dim]).max() <= 1e-6 * now[0]:
            break
        last = now
    by_unit = times(cells.join(vectors, "t"), "t", "v", "u")
    values, axes = np.linalg.eigh(products(by_unit))
    axes, values = axes[:, ::-1][:, :dim], np.sqrt(np.maximum(values[::-1][:dim], 0))
    vectors = turned(vectors, axes).checkpoint()
    ends = vectors.agg(*(F.max_by(F.col("v")[i], F.abs(F.col("v")[i])).alias(f"e{i}") for i in range(axes.shape[1]))).first()
    sign = [1.0 if ends[i] >= 0 else -1.0 for i in range(axes.shape[1])]
    return vectors.select(F.col("t").alias(term), F.array(*(F.col("v")[i] * s for i, s in enumerate(sign))).alias("v")), values


def term_embeddings(weights: DataFrame, unit: str, dim: int, term: str = "termino", value: str = "ppmi") -> DataFrame:
    """word, vec: V sqrt(sigma) of the unit by term matrix, for every term it holds.

    Terms are rows of V, not of U; the matrix is never collected (:func:`leading_vectors`).
    """
    vectors, sigma = leading_vectors(weights, unit, term, value, dim)
    scaled = F.array(*(F.col("v")[i] * float(np.sqrt(s)) for i, s in enumerate(sigma))) if len(sigma) else F.array().cast("array<double>")
    return vectors.select(F.col(term).alias("word"), scaled.alias("vec"))


def aligned(source: DataFrame, target: DataFrame, dim_source: int, dim_target: int, ridge: float = 1e-6) -> DataFrame:
    """``source`` vectors in the space of ``target``, by least squares over the words both have.

    The normal equations are added up in Spark: dim_source x (dim_source + dim_target) numbers.
    """
    both = source.select("word", F.col("vec").alias("s")).join(target.select("word", F.col("vec").alias("t")), "word")
    left = [F.sum(F.col("s")[i] * F.col("s")[j]).alias(f"a{i}_{j}") for i in range(dim_source) for j in range(i, dim_source)]
    right = [F.sum(F.col("s")[i] * F.col("t")[j].cast("double")).alias(f"b{i}_{j}") for i in range(dim_source) for j in range(dim_target)]
    got = both.agg(*left, *right).first()
    a, b = np.eye(dim_source) * ridge, np.zeros((dim_source, dim_target))
    for i in range(dim_source):
        for j in range(i, dim_source):
            a[i, j] += got[f"a{i}_{j}"] or 0.0
            a[j, i] = a[i, j]
        for j in range(dim_target):
            b[i, j] = got[f"b{i}_{j}"] or 0.0
    w = np.linalg.solve(a, b)
    return source.select("word", F.array(*(sum((F.col("vec")[i] * float(w[i, j]) for i in range(1, dim_source)), F.col("vec")[0] * float(w[0, j])) for j in range(dim_target))).alias("vec"))


def centroid_export(centroids: DataFrame, scored: DataFrame, label: str, term: str = "termino", top: int = 10) -> DataFrame:
    """Centroids with the ``top`` positive terms of their class by chi-square."""
    rank = F.row_number().over(Window.partitionBy(label).orderBy(F.desc("chi2_yates"), term))
    best = scored.where("phi > 0").withColumn("r", rank).where(F.col("r") <= top)
    listed = best.groupBy(label).agg(F.sort_array(F.collect_list(F.struct("r", term))).alias("t")).select(label, F.col(f"t.{term}").alias("terminos"))
    return centroids.join(listed, label, "left")
