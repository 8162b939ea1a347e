"""Characteristic terms of classes, their tests and their stability."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesela.functions.distributions import CHI2_95, chi2_sf

#: Units whose draws of all rounds are held at once; bins of hashes in the search for a rank.
BLOCK, BINS = 5_000, 4096


def yates(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Chi-square of a 2 x 2 table with Yates' correction; null if a margin is 0."""
    n = a + b + c + d
    gap = F.greatest(F.lit(0.0), F.abs(a * d - b * c) - n / 2)
    margins = (a + b) * (c + d) * (a + c) * (b + d)
    return F.when(margins > 0, n * gap * gap / margins)


def characteristic_terms(incidence: DataFrame, classes: DataFrame, unit: str, label: str, term: str = "termino", noise: int = -1) -> DataFrame:
    """Chi-square, phi, V and C of every term in every class, also where they never meet.

    ``classes`` (unit, label); noise and null labels are left out, and with fewer than two classes there is
    no result. The grid of terms and classes comes from three small marginals. The sign of phi is that of
    the difference between the term's rate in the class and in all units. ``significativo`` is the plain
    test at 5 % (chi-square above its 95 % point).
    """
    known = classes.where(F.col(label).isNotNull() & (F.col(label) != F.lit(noise)))
    joined = incidence.join(known, unit)
    cells = joined.groupBy(term, label).agg(F.count(F.lit(1)).alias("a"))
    by_term = joined.groupBy(term).agg(F.count(F.lit(1)).alias("frecuencia_global"))
    by_class = known.groupBy(label).agg(F.count(F.lit(1)).alias("n_clase"))
    total = Window.partitionBy()  # one row per class
    by_class = by_class.withColumn("n", F.sum("n_clase").over(total)).withColumn("_clases", F.count(F.lit(1)).over(total)).where("_clases > 1").drop("_clases")
    # every class goes with every term: an explode of the few classes, not a join
    listed = by_class.agg(F.collect_list(F.struct(label, "n_clase", "n"))).scalar()
    grid = by_term.withColumn("clases", listed).select(term, "frecuencia_global", F.explode("clases").alias("c")).select(term, "frecuencia_global", "c.*")
    full = grid.join(cells, [term, label], "left").fillna(0, ["a"])
    a = F.col("a").cast("double")
    b, c = F.col("frecuencia_global") - a, F.col("n_clase") - a
    d = F.col("n") - a - b - c
    scored = full.withColumn("chi2_yates", yates(a, b, c, d)).where("chi2_yates is not null")
    sign = F.when(a / F.col("n_clase") > F.col("frecuencia_global") / F.col("n"), 1.0).otherwise(-1.0)
    root = F.sqrt(F.col("chi2_yates") / F.col("n"))
    return scored.select(
        term, label, "frecuencia_global", F.col("a").cast("long").alias("frecuencia_cluster"), F.round("chi2_yates", 4).alias("chi2_yates"),
        F.round(sign * root, 4).alias("phi"), F.round(root, 4).alias("cramer_v"),
        F.round(F.sqrt(F.col("chi2_yates") / (F.col("chi2_yates") + F.col("frecuencia_global"))), 4).alias("c"),
        (F.col("chi2_yates") > CHI2_95).alias("significativo"),
    )


def benjamini_hochberg(df: DataFrame, p: str, *group: str, name: str = "p_adj") -> DataFrame:
    """Adjusted p in each group: the least p m / rank among this and the larger ones, at most 1."""
    whole = Window.partitionBy(*group)
    rank = F.row_number().over(whole.orderBy(p))
    raw = F.col(p) * F.count(F.lit(1)).over(whole) / rank
    least = F.min("_raw").over(whole.orderBy(F.desc(p), F.desc("_rank")).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("_rank", rank).withColumn("_raw", raw).withColumn(name, F.least(least, F.lit(1.0))).drop("_rank", "_raw")


def with_p_values(terms: DataFrame, label: str) -> DataFrame:
    """Adds p_valor (chi-square, one degree of freedom) and p_adj by class."""
    return benjamini_hochberg(terms.withColumn("p_valor", chi2_sf(F.col("chi2_yates"))), "p_valor", label)


def round_hashes(h: np.ndarray, rounds: int, seed: int) -> np.ndarray:
    """xxhash64(unit, round, seed) as Spark has it, a row for each unit, from h = xxhash64(unit)."""
    p1, p2, p3, p5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))

    def mixed(value, h: np.ndarray) -> np.ndarray:
        h = (h + p5 + np.uint64(4)) ^ (value * p1)
        h = ((h << np.uint64(23)) | (h >> np.uint64(41))) * p2 + p3
        h = (h ^ (h >> np.uint64(33))) * p2
        h = (h ^ (h >> np.uint64(29))) * p3
        return h ^ (h >> np.uint64(32))

    each = np.arange(rounds, dtype=np.uint64)[None]
    return mixed(np.array([[seed & 0xFFFFFFFF]], dtype=np.uint64), mixed(each, h.view(np.uint64)[:, None])).view(np.int64)


def _blocks(batches: Iterator[pa.RecordBatch], rounds: int, seed: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(class numbers, hashes of all rounds) of columns h and k, some units at a time."""
    for batch in batches:
        h, k = batch.column("h").to_numpy(), batch.column("k").to_numpy()
        for at in range(0, len(h), BLOCK):
            yield k[at : at + BLOCK], round_hashes(h[at : at + BLOCK], rounds, seed)


def _numbered(classes: DataFrame, unit: str, label: str) -> tuple[DataFrame, Column, list[int]]:
    """((unit, h, k) of the units with a class, labels as an array, size of each class); h is the hash of the unit, k the class's number."""
    known = classes.where(F.col(label).isNotNull() & (F.col(label) != -1)).select(unit, label)
    sizes = sorted((r[label], r["count"]) for r in known.groupBy(label).count().collect())
    names = F.array(*(F.lit(x) for x, _ in sizes)).cast(f"array<{dict(classes.dtypes)[label]}>")
    return known.select(unit, F.xxhash64(unit).alias("h"), (F.array_position(names, F.col(label)) - 1).cast("int").alias("k")), names, [n for _, n in sizes]


def permutation_thresholds(incidence: DataFrame, classes: DataFrame, unit: str, label: str, term: str = "termino", rounds: int = 20, seed: int = 42, q: float = 0.95) -> DataFrame:
    """Per term and class, the ``q`` quantile of (a - E)^2 / E when labels are dealt anew ``rounds`` times.

    The labels of each round are those of the units in the order of a seeded hash: a unit's label follows from
    its hash and the hashes at the borders of the classes, which are found by counting in bins and sorting the bins
    that hold a border. So no row is made for a unit and a round; a term's cells go to one kernel, some at a time.
    Units of the same 64-bit hash get the same label.
    """
    known, names, sizes = _numbered(classes, unit, label)
    if not sizes:
        return incidence.join(classes.select(unit, label), unit).where("false").select(term, label, F.lit(0.0).alias("umbral"))
    n, ends = sum(sizes), np.cumsum(sizes)[:-1]
    shift = 64 - int(np.log2(BINS))
    of = lambda hashes: ((hashes >> shift) + BINS // 2).astype(np.int64)

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(rounds * BINS, dtype=np.int64)
        for _, hashes in _blocks(batches, rounds, seed):
            count += np.bincount((of(hashes) + np.arange(rounds) * BINS).ravel(), minlength=rounds * BINS)
        at = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(count[at])], ["b", "n"])

    got = known.select("h", "k").mapInArrow(binned, "b long, n long").groupBy("b").agg(F.sum("n").alias("n")).toArrow()
    count = np.zeros(rounds * BINS, dtype=np.int64)
    count[got.column("b").to_numpy()] = got.column("n").to_numpy()
    before = np.cumsum(count.reshape(rounds, BINS), axis=1)
    wanted = [(r, j, int(np.searchsorted(before[r], end, side="right")), int(end)) for r in range(rounds) for j, end in enumerate(ends)]
    wanted = [(r, j, b, end - (int(before[r, b - 1]) if b else 0)) for r, j, b, end in wanted]
    held = np.zeros((rounds, BINS), dtype=bool)
    for r, _, b, _ in wanted:
        held[r, b] = True

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, hashes in _blocks(batches, rounds, seed):
            bins = of(hashes)
            row, r = np.nonzero(held[np.arange(rounds)[None], bins])
            yield pa.RecordBatch.from_arrays([pa.array(r * BINS + bins[row, r]), pa.array(hashes[row, r])], ["b", "v"])

    cuts = np.zeros((rounds, len(ends)), dtype=np.int64)
    if wanted:
        asked = known.sparkSession.createDataFrame([(r * BINS + b, r, j, place + 1) for r, j, b, place in wanted], "b long, r int, j int, place int")
        lists = known.select("h", "k").mapInArrow(inside, "b long, v long").groupBy("b").agg(F.sort_array(F.collect_list("v")).alias("v"))
        for x in lists.join(F.broadcast(asked), "b").select("r", "j", F.element_at("v", F.col("place")).alias("v")).collect():
            cuts[x["r"], x["j"]] = x["v"]
    shares = np.array(sizes)

    def scored(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, f = np.zeros((rounds, len(shares))), 0
        for _, hashes in _blocks(batches, rounds, seed):
            f += len(hashes)
            for r in range(rounds):
                a[r] += np.bincount(np.searchsorted(cuts[r], hashes[:, r], side="right"), minlength=len(shares))
        expected = f * shares / n
        x = np.sort((a - expected) ** 2 / expected, axis=0)
        at = (rounds - 1) * q
        low = int(at)
        found = x[low] if at == low else (low + 1 - at) * x[low] + (at - low) * x[low + 1]
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()] * len(shares), pa.string()), pa.array(np.arange(1, len(shares) + 1), pa.int32()), pa.array(found)], [term, "k", "umbral"])

    cells = incidence.select(unit, term).join(known, unit).select(term, "h", "k")
    return cells.groupBy(term).applyInArrow(scored, f"`{term}` string, k int, umbral double").select(term, F.element_at(names, F.col("k")).alias(label), "umbral")


def term_stability(incidence: DataFrame, classes: DataFrame, unit: str, label: str, term: str = "termino", rounds: int = 10, seed: int = 42) -> DataFrame:
    """How often each term is characteristic of each class when units are drawn anew, Poisson bootstrap.

    In each round a unit weighs 0, 1, 2 … with a seeded Poisson(1) draw, so rounds need no collected sample. The draws
    of all rounds are made in the kernels, a term's cells in one, some at a time: no row is made for a cell and a round.
    """
    known, names, sizes = _numbered(classes, unit, label)
    classes_ = len(sizes)
    bounds = np.array((0.36787944117, 0.73575888234, 0.91969860293, 0.98101184312, 0.99634015317, 0.99940581518))

    def drawn(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        """Summed weights by class and round."""
        out = np.zeros((classes_, rounds))
        for k, hashes in _blocks(batches, rounds, seed):
            w = np.searchsorted(bounds, (hashes & ((1 << 40) - 1)) / float(1 << 40), side="right")
            for j in np.unique(k):
                out[j] += w[k == j].sum(axis=0)
        return out

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = drawn(batches)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["b", "n"])

    size = np.zeros(classes_ * rounds)
    for x in known.select("h", "k").mapInArrow(partial, "b long, n double").groupBy("b").agg(F.sum("n").alias("n")).collect():
        size[x["b"]] = x["n"]
    size = size.reshape(classes_, rounds)
    n = size.sum(axis=0)

    def scored(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = drawn(batches)
        f = a.sum(axis=0)
        b, c = f - a, size - a
        d = n - a - b - c
        margins = (a + b) * (c + d) * (a + c) * (b + d)
        gap = np.maximum(0.0, np.abs(a * d - b * c) - n / 2)
        with np.errstate(divide="ignore", invalid="ignore"):
            kept = (a > 0) & (margins > 0) & (n * gap * gap / margins > CHI2_95) & (a / size > f / n)
        at = np.flatnonzero((a > 0).any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()] * len(at), pa.string()), pa.array(at + 1, pa.int32()), pa.array(kept[at].sum(axis=1) / rounds)], [term, "k", "frecuencia_seleccion"])

    cells = incidence.select(unit, term).join(known, unit).select(term, "h", "k")
    return cells.groupBy(term).applyInArrow(scored, f"`{term}` string, k int, frecuencia_seleccion double").select(term, F.element_at(names, F.col("k")).alias(label), "frecuencia_seleccion")


def unit_phi(incidence: DataFrame, classes: DataFrame, scored: DataFrame, unit: str, label: str, term: str = "termino", places: int = 4) -> DataFrame:
    """Mean phi of the significant, positive terms of its class that a unit has; 0 if it has none."""
    good = scored.where("significativo and phi > 0").select(term, label, "phi")
    known = classes.where(F.col(label).isNotNull() & (F.col(label) != -1))
    present = incidence.join(known, unit).join(good, [term, label]).groupBy(unit).agg(F.round(F.avg("phi"), places).alias("phi"))
    return known.join(present, unit, "left").fillna(0.0, ["phi"]).select(unit, label, "phi")


def term_map(incidence: DataFrame, classes: DataFrame, scored: DataFrame, unit: str, label: str, term: str = "termino") -> DataFrame:
    """Map of the significant terms of its class that a unit has, of either sign, to their phi."""
    good = scored.where("significativo").select(term, label, "phi")
    pairs = incidence.join(classes, unit).join(good, [term, label])
    return pairs.groupBy(unit).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(term, "phi")))).alias("phi_coefficients"))


def top_terms(scored: DataFrame, label: str, top: int = 10, term: str = "termino") -> DataFrame:
    """The ``top`` terms of each class by the size of phi, ties by term."""
    rank = F.row_number().over(Window.partitionBy(label).orderBy(F.desc(F.abs("phi")), term))
    return scored.withColumn("puesto", rank).where(F.col("puesto") <= top)
