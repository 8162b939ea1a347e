"""Problem 7: similarity clusters by grid density, described and named."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: A cell is dense with at least this share of all usable units, so there are at most 1 / share of them, and with at least so many units.
DENSE_SHARE, DENSE_LEAST = 0.0005, 4
#: Edge of a cell: so many standard deviations of the axes that tell no groups apart, and at least so much, in the space of unit vectors.
CELL_DEVIATIONS, CELL_LEAST = 3.3, 0.05
#: Means closer than this belong to one group.
SAME_GROUP = 0.8


def _vectors(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors and where they are usable: of the right length, finite and not all zero."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    out = np.zeros((len(column), dim))
    lengths = np.asarray(column.value_lengths().fill_null(0))
    right = lengths == dim
    if right.any():
        flat = column.filter(pa.array(right)).flatten()
        out[right] = np.asarray(flat.cast(pa.float64()).fill_null(np.nan), dtype=float).reshape(-1, dim)
    scale = np.abs(out).max(axis=1)
    usable = right & np.isfinite(scale) & (scale > 0)
    out[usable] /= scale[usable, None]
    out[usable] /= np.linalg.norm(out[usable], axis=1)[:, None]
    out[~usable] = 0
    return out, usable


def principal_axes(units: DataFrame, embedding: str, dim: int) -> tuple[np.ndarray, float, int]:
    """The axes of the unit vectors that tell groups apart, the edge of a cell, and the number of usable units.

    Axes of more than the mean variance are kept; the lesser half of the variances is that within groups and
    gives the edge. So both follow from the vectors alone. Partitions give the sums of products, Spark adds
    them, the driver gets dim x (dim + 1) + 1 numbers.
    """

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(dim * dim + dim + 1)
        for batch in batches:
            x, usable = _vectors(batch.column(0), dim)
            total[: dim * dim] += (x.T @ x).ravel()
            total[dim * dim : -1] += x.sum(axis=0)
            total[-1] += usable.sum()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["i", "v"])

    rows = units.select(embedding).mapInArrow(moments, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    total = np.zeros(dim * dim + dim + 1)
    for r in rows:
        total[r["i"]] = r["v"]
    n = total[-1]
    if n == 0:
        return np.zeros((dim, 1)), CELL_LEAST, 0
    mean = total[dim * dim : -1] / n
    variances, axes = np.linalg.eigh(total[: dim * dim].reshape(dim, dim) / n - np.outer(mean, mean))
    variances = np.maximum(variances, 0)
    within = float(variances[: max(1, dim // 2)].mean()) if dim > 1 else 0.0
    axes = axes[:, ::-1][:, : max(1, int((variances > variances.mean()).sum()))]
    axes = axes * np.where(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])] < 0, -1.0, 1.0)
    return axes, max(CELL_LEAST, CELL_DEVIATIONS * within**0.5), int(n)


def grid_cells(units: DataFrame, embedding: str, axes: np.ndarray, cell: float) -> DataFrame:
    """(celda, n, suma): quantised position, units in it and the sum of their unit vectors.

    Cells are added up in each partition before the exchange; its rows are cells, not units.
    """
    dim, n_axes = axes.shape

    def quantise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, usable = _vectors(batch.column(0), dim)
            x = x[usable]
            if not len(x):
                continue
            keys, where = np.unique(np.floor(x @ axes / cell).astype(np.int32), axis=0, return_inverse=True)
            where = where.ravel()
            sums = np.zeros((len(keys), dim))
            np.add.at(sums, where, x)
            counts = np.bincount(where, minlength=len(keys)).astype(np.int64)
            lists = [
                pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, m.shape[1], dtype=np.int32)), pa.array(m.ravel()))
                for m in (keys, sums)
            ]
            yield pa.RecordBatch.from_arrays([lists[0], pa.array(counts), lists[1]], ["celda", "n", "suma"])

    cells = units.select(embedding).mapInArrow(quantise, "celda array<int>, n long, suma array<double>")
    sums = [F.sum(F.col("suma")[i]).alias(f"s{i}") for i in range(dim)]
    return cells.groupBy("celda").agg(F.sum("n").alias("n"), *sums).select("celda", "n", F.array(*(f"s{i}" for i in range(dim))).alias("suma"))


def dense_components(cells: DataFrame, least: int) -> DataFrame:
    """(celda, n, suma, grupo) of the dense cells; grupo is the least cell number of the component.

    Dense cells that differ by one step in one axis are joined, and each takes the least label among its
    neighbours until none changes. There are at most units / ``least`` dense cells; each round is one
    join of them, and its result is written to the checkpoint folder.
    """
    dense = cells.where(F.col("n") >= least)
    dense = dense.withColumn("grupo", F.xxhash64("celda")).coalesce(4).checkpoint()
    steps = F.explode(
        F.flatten(
            F.transform(
                F.sequence(F.lit(0), F.size("celda") - 1),
                lambda i: F.transform(
                    F.array(F.lit(-1), F.lit(1)),
                    lambda d: F.transform(F.col("celda"), lambda v, j: F.when(j == i, v + d).otherwise(v)),
                ),
            )
        )
    )
    near = dense.select(F.col("celda").alias("de"), steps.alias("celda")).join(dense.select("celda"), "celda", "left_semi")
    edges = near.union(dense.select(F.col("celda").alias("de"), "celda")).coalesce(4).checkpoint()
    labels = dense.select("celda", "grupo")
    while True:
        moved = (
            edges.join(labels, "celda").groupBy("de").agg(F.min("grupo").alias("nuevo"))
            .withColumnRenamed("de", "celda").join(labels, "celda").coalesce(4).checkpoint()
        )
        changed = moved.where("nuevo < grupo").limit(1).count()
        labels = moved.select("celda", F.col("nuevo").alias("grupo"))
        if not changed:
            return dense.drop("grupo").join(labels, "celda")


def group_directions(components: list, n_groups: int) -> np.ndarray:
    """Mean directions of the ``n_groups`` largest groups of dense cells, one row each.

    ``components`` are the rows of :func:`dense_components`. Those whose means are closer than SAME_GROUP are
    parts of one group.
    """
    sums: dict[int, np.ndarray] = {}
    for r in components:
        sums[r["grupo"]] = sums.get(r["grupo"], 0) + np.array(r["suma"])
    found: list[np.ndarray] = []
    for _, s in sorted(sums.items(), key=lambda kv: (-np.linalg.norm(kv[1]), kv[0])):
        for k, t in enumerate(found):
            if s @ t / (np.linalg.norm(s) * np.linalg.norm(t)) >= SAME_GROUP:
                found[k] = t + s
                break
        else:
            found.append(s)
    found.sort(key=lambda s: -np.linalg.norm(s))
    top = np.array(found[:n_groups])
    return top / np.maximum(np.linalg.norm(top, axis=1, keepdims=True), 1e-300) if len(top) else top


def assign(units: DataFrame, embedding: str, means: np.ndarray, least: float, keep: tuple[str, ...], axes: np.ndarray, cell: float, dense: dict) -> DataFrame:
    """Columns ``keep``, grupo (row of ``means`` nearest by cosine, null under ``least``), coseno, densidad.

    densidad is the number of units in the unit's cell, 0 where that is not dense; ``dense`` has at most
    1 / DENSE_SHARE cells.
    """
    dim = len(axes)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, usable = _vectors(batch.column(embedding), dim)
            cosine = x @ means.T if len(means) else np.full((len(x), 1), -1.0)
            best = cosine.argmax(axis=1)
            value = cosine[np.arange(len(x)), best]
            member = usable & (value >= least)
            places = np.floor(x @ axes / cell).astype(np.int32)
            density = [dense.get(tuple(p), 0) if u else 0 for p, u in zip(places.tolist(), usable)]
            columns = [batch.column(c) for c in keep]
            columns += [pa.array(best.astype(np.int32), mask=~member), pa.array(value, mask=~usable), pa.array(density, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [*keep, "grupo", "coseno", "densidad"])

    kinds = dict(units.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "grupo int, coseno double, densidad long"])
    return units.select(*dict.fromkeys([*keep, embedding])).mapInArrow(nearest, schema)


def cluster(
    units: DataFrame, key: str = "uc_id", embedding: str = "embedding", label: str = "cluster_id", least: float = 0.6,
    noise: int = -1,
) -> DataFrame:
    """``key``, ``label``, grupo, nombre, coseno, densidad: each unit's group, the group's name, its likeness, the units of its cell.

    ``units`` holds each key once. There are as many groups as recorded names (null and ``noise`` are
    none). A group is named by the label most of its units carry, each name given once; on ties the
    smaller one. A group needs a dense cell: one of DENSE_LEAST units and DENSE_SHARE of all. Units without a usable embedding (null, zero, not finite, of another length), or less
    like every mean than ``least``, have no group. Without names or usable units no unit has one.
    """
    names = [
        r[label] for r in units.where(F.col(label).isNotNull() & (F.col(label) != noise)).groupBy(label).count().orderBy(label).collect()
    ]  # one row per recorded class
    sizes = units.where(F.col(embedding).isNotNull()).groupBy(F.size(embedding).alias("d")).count().collect()
    dims = sorted(((r["count"], r["d"]) for r in sizes if r["d"] > 0), reverse=True)
    dim = dims[0][1] if dims else 1
    axes, cell, usable = principal_axes(units, embedding, dim)
    means, dense = np.zeros((0, dim)), {}
    if usable and names:
        least_units = max(DENSE_LEAST, int(np.ceil(usable * DENSE_SHARE)))
        components = dense_components(grid_cells(units, embedding, axes, cell), least_units).collect()  # at most 1 / DENSE_SHARE rows
        found = group_directions(components, len(names))
        means = found if len(found) else means
        dense = {tuple(r["celda"]): r["n"] for r in components}
    members = assign(units, embedding, means, least, (key, label), axes, cell, dense).checkpoint()
    votes = members.where(F.col("grupo").isNotNull() & F.col(label).isin(names)).groupBy("grupo", label).count().collect() if names else []
    named: dict[int, int] = {}
    for r in sorted(votes, key=lambda r: (-r["count"], r[label], r["grupo"])):  # at most names x names rows
        if r["grupo"] not in named and r[label] not in named.values():
            named[r["grupo"]] = r[label]
    pairs = F.create_map(*(F.lit(x) for kv in named.items() for x in kv)) if named else None
    name = pairs[F.col("grupo")] if named else F.lit(None)
    return members.withColumn("nombre", name.cast(dict(units.dtypes)[label]))


def describe(clustered: DataFrame, key: str = "uc_id", label: str = "cluster_id", top: int = 5) -> DataFrame:
    """Each group with its name, size, mean likeness, share rightly recorded and most typical members: those of its
    densest cells, the most alike to its mean first.

    The rank limit is applied in each partition before the exchange, so a group of a third of all units
    sends ``top`` rows from each.
    """
    members = clustered.where("grupo is not null")
    rank = F.row_number().over(Window.partitionBy("grupo").orderBy(F.desc("densidad"), F.desc("coseno"), key))
    typical = (
        members.select("grupo", key, "coseno", "densidad").withColumn("puesto", rank).where(F.col("puesto") <= top)
        .groupBy("grupo").agg(F.sort_array(F.collect_list(F.struct("puesto", key))).alias("t"))
        .select("grupo", F.col(f"t.{key}").alias("tipicas"))
    )
    right = F.coalesce((F.col(label) == F.col("nombre")).cast("double"), F.lit(0.0))
    sizes = members.groupBy("grupo").agg(
        F.first("nombre").alias("nombre"), F.count(F.lit(1)).alias("unidades"), F.avg("coseno").alias("coseno_medio"),
        F.avg(right).alias("bien_registradas"),
    )
    return sizes.join(typical, "grupo")
