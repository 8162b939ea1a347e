"""Problem 4: items that appear together, against a fitted bipartite configuration null."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Frequencies up to here keep a class of their own in the null; larger ones share classes 1 % wide.
EXACT_CLASSES = 512
#: A vocabulary of up to so many items is broadcast; a larger one is joined by exchange.
BROADCAST_ITEMS = 200_000
#: Items of a record whose pairs one row makes, at most; wider records are cut into blocks of so many.
WIDE = 1024
#: Parts into which the rows of an item are dealt when they are joined by exchange.
SALTS = 16
#: Width of a class of -log10 p when q values are made, and the number of such classes.
P_STEP, P_CLASSES = 0.02, 20_000


def _class_of(column):
    """Frequencies by class: exact to EXACT_CLASSES, then geometric. So their number is bounded."""
    wide = F.floor(F.log(column / EXACT_CLASSES) / math.log(1.01))
    return F.when(column <= EXACT_CLASSES, column.cast("double")).otherwise(
        F.round(EXACT_CLASSES * F.pow(F.lit(1.01), wide + 0.5), 3)
    )


def fit_null(degrees: np.ndarray, items: np.ndarray, sizes: np.ndarray, records: np.ndarray, steps: int = 300):
    """Fitness of items (by degree) and of records (by size) of the maximum-entropy bipartite null.

    P(item in record) = xy / (1 + xy), with the expected degree of every item and the expected size of
    every record as observed. ``items`` and ``records`` tell how many have each degree and size.
    """
    total = float((degrees * items).sum())
    x, y = degrees / math.sqrt(total), sizes / math.sqrt(total)
    for _ in range(steps):
        x_new = degrees / ((records * y) / (1 + np.outer(x, y))).sum(axis=1)
        y_new = sizes / (((items * x_new)[:, None]) / (1 + np.outer(x_new, y))).sum(axis=0)
        done = np.abs(x_new / x - 1).max() < 1e-9
        x, y = x_new, y_new
        if done:
            break
    return x, y


def poisson_binomial_tail(q: np.ndarray, weights: np.ndarray, k: np.ndarray) -> np.ndarray:
    """P(X >= k), X a sum of independent trials: ``weights[j]`` of them with probability ``q[i, j]``.

    Second-order saddlepoint (Lugannani-Rice) with continuity correction; k above the mean. At or
    below the mean the tail is given as 1, which no report of surprise uses.
    """
    mean = (q * weights).sum(axis=1)
    out = np.ones(len(k))
    todo = np.flatnonzero(k - 0.5 > mean + 1e-9)
    for chunk in np.array_split(todo, max(1, len(todo) * q.shape[1] // 400_000)):
        if not len(chunk):
            continue
        p, target = q[chunk], k[chunk] - 0.5
        s = np.log(target / mean[chunk])
        for _ in range(40):
            e = np.exp(s)[:, None]
            r = p * e / (1 - p + p * e)
            first, second = (weights * r).sum(axis=1), (weights * r * (1 - r)).sum(axis=1)
            step = (first - target) / np.maximum(second, 1e-300)
            s = s - np.clip(step, -1, 1)
            if np.abs(step).max() < 1e-10:
                break
        e = np.exp(s)[:, None]
        r = p * e / (1 - p + p * e)
        second = (weights * r * (1 - r)).sum(axis=1)
        cumulant = (weights * np.log1p(p * (e - 1))).sum(axis=1)
        w = np.sqrt(np.maximum(2 * (s * target - cumulant), 1e-300))
        u = 2 * np.sinh(s / 2) * np.sqrt(second)
        erfc = np.array([math.erfc(v / math.sqrt(2)) / 2 for v in w])
        density = np.exp(-w * w / 2) / math.sqrt(2 * math.pi)
        out[chunk] = np.clip(erfc + density * (1 / u - 1 / w), 0, 1)
    return out


def item_counts(baskets: DataFrame, items: str) -> DataFrame:
    """(item, n): records that hold each item. Summed in each partition before the exchange."""
    return baskets.select(F.explode(items).alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("n"))


def _join_items(rows: DataFrame, vocabulary: DataFrame, on: str, spread: str, small: bool) -> DataFrame:
    """``rows`` with the columns of their item: a small vocabulary is broadcast, a larger one repeated for
    each of SALTS parts of the rows (by ``spread``), so that no task gets all rows of a frequent item."""
    if small:
        return rows.join(F.broadcast(vocabulary), on)
    salted = rows.withColumn("sal", F.pmod(F.xxhash64(spread), F.lit(SALTS)))
    each = vocabulary.withColumn("sal", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return salted.join(each, [on, "sal"]).drop("sal")


def _item_ids(baskets: DataFrame, items: str, vocabulary: DataFrame, small: bool) -> DataFrame:
    """(ids): the sorted numbers of each record's items. With a small vocabulary the items are looked up in place,
    batch by batch; a larger one is joined by exchange and the records are put together again."""
    if not small:
        held = baskets.withColumn("r", F.monotonically_increasing_id()).select("r", F.explode(items).alias("item"))
        joined = _join_items(held, vocabulary.select("item", "id"), "item", "r", small)
        return joined.groupBy("r").agg(F.sort_array(F.collect_list("id")).alias("ids")).select("ids")
    rows = vocabulary.select("item", "id").toArrow()  # at most BROADCAST_ITEMS rows
    names = baskets.sparkSession.sparkContext.broadcast((rows.column("item").to_pylist(), rows.column("id").to_numpy()))

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, ids = names.value
        words = pa.array(words, pa.string())
        for batch in batches:
            lists = batch.column(0)
            at = pc.index_in(lists.flatten(), value_set=words)
            known = np.asarray(at.is_valid())
            of = np.repeat(np.arange(len(lists)), np.asarray(lists.value_lengths().fill_null(0)))[known]
            own = ids[np.asarray(at.drop_null())]
            order = np.lexsort((own, of))
            offsets = np.zeros(len(lists) + 1, dtype=np.int32)
            np.cumsum(np.bincount(of, minlength=len(lists)), out=offsets[1:])
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(offsets), pa.array(own[order]))], ["ids"])

    return baskets.select(items).mapInArrow(numbered, "ids array<long>")


def _pairs(ids: DataFrame, widest: int) -> DataFrame:
    """(a, b), a < b: every two numbers of a record. Records of more than WIDE items, if there are any, are cut into
    blocks of WIDE and every two blocks are dealt to the tasks, so that none makes all pairs of a huge record."""
    near = (
        ids.where(F.size("ids") <= WIDE).select("ids", F.posexplode("ids").alias("i", "a"))
        .select("a", F.explode(F.slice(F.col("ids"), F.col("i") + 2, F.size("ids"))).alias("b"))
    )
    if widest <= WIDE:
        return near
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size("ids") - 1) / WIDE).cast("int")), lambda k: F.slice(F.col("ids"), k * WIDE + 1, WIDE))
    cut = ids.where(F.size("ids") > WIDE).select(blocks.alias("blocks"))
    two = cut.select("blocks", F.posexplode("blocks").alias("i", "x")).select("x", F.explode(F.slice(F.col("blocks"), F.col("i") + 1, F.size("blocks"))).alias("y"))
    dealt = two.repartition(F.xxhash64("x", "y"))
    return near.unionAll(dealt.select(F.explode("x").alias("a"), "y").select("a", F.explode("y").alias("b")).where("a < b"))


def pair_counts(baskets: DataFrame, items: str, counts: DataFrame, name: str, n_records: int, min_pairs: int = 1, per: int = 0, lift: int = 0):
    """Exact counts of all pairs, or of those that hold the bounds.

    ``baskets`` holds each record's distinct items. A bound of 0 (``per``, ``lift``) or 1 (``min_pairs``)
    is none. A pair with n_ab >= min_pairs, per n_ab >= N and n_ab N >= lift n_a n_b has both items in at
    least min_pairs and N / per records and in at most N / lift: so other items are left out before any
    pair is made, and no pair that counts is lost. Pairs are summed in each partition before the exchange.
    """
    least = max(min_pairs, -(-n_records // per) if per else 1)
    vocabulary = (
        counts.where((F.col("n") >= least) & (F.col("n") * lift <= n_records))
        .withColumn("id", F.monotonically_increasing_id())
        .checkpoint()
    )
    small = vocabulary.count() <= BROADCAST_ITEMS
    widest = baskets.agg(F.max(F.size(items)).alias("k")).first()["k"] or 0
    pairs = (
        _pairs(_item_ids(baskets, items, vocabulary, small), widest)
        .groupBy("a", "b")
        .agg(F.count(F.lit(1)).alias("n_ab"))
        .where(F.col("n_ab") >= least)
    )
    one = vocabulary.select(F.col("id").alias("a"), F.col("item").alias("item_1"), F.col("n").alias("n_1"))
    two = vocabulary.select(F.col("id").alias("b"), F.col("item").alias("item_2"), F.col("n").alias("n_2"))
    named = _join_items(_join_items(pairs, one, "a", "b", small), two, "b", "a", small).where(F.col("n_ab") * n_records >= lift * F.col("n_1") * F.col("n_2"))
    forward = F.col("item_1") < F.col("item_2")
    return named.select(
        F.least("item_1", "item_2").alias(f"{name}_a"),
        F.greatest("item_1", "item_2").alias(f"{name}_b"),
        F.when(forward, F.col("n_1")).otherwise(F.col("n_2")).alias("n_a"),
        F.when(forward, F.col("n_2")).otherwise(F.col("n_1")).alias("n_b"),
        "n_ab",
    )


def pair_surprise(
    baskets: DataFrame, items: str, name: str, n_records: int, min_pairs: int = 1, per: int = 0, lift: int = 0
) -> DataFrame:
    """Pairs of items with their count, what chance gives, and how surprising the count is.

    Columns: item_a < item_b, n_a, n_b, n_ab, ``esperado`` (mean under the bipartite configuration
    null, which keeps the frequency of items and the size of records), ``veces`` (n_ab over it),
    ``p`` (Poisson-binomial upper tail) and ``q`` (Benjamini-Hochberg over all pairs of all items,
    rounded up to the next class of P_STEP in -log10 p). An empty input gives an empty result.
    Every pair held by a record comes out, those below chance with p and q of 1. With bounds (see
    ``pair_counts``) only the pairs that hold them do, and q is an upper bound, as the others have no rank.
    ``baskets`` has the array ``items`` of each record's distinct items, null for none; it is written once
    to the checkpoint folder, as it is read for the frequencies, the sizes and the pairs.

    What the driver gets is bounded: classes of degrees and of sizes, and classes of p.
    """
    baskets = baskets.select(items).checkpoint().where(F.size(items) > 0)  # the filter after it: before, the items would be made twice
    counts = item_counts(baskets, items).checkpoint()
    pairs = pair_counts(baskets, items, counts, name, n_records, min_pairs, per, lift)
    by_degree = (
        counts.groupBy(_class_of(F.col("n")).alias("c")).agg(F.count(F.lit(1)).alias("items"), F.avg("n").alias("n")).collect()
    )
    by_size = (
        baskets.select(F.size(items).alias("k")).groupBy(_class_of(F.col("k")).alias("c"))
        .agg(F.count(F.lit(1)).alias("records"), F.avg("k").alias("k")).collect()
    )
    if not by_degree:
        return pairs.select("*", *(F.lit(None).cast("double").alias(c) for c in ("esperado", "veces", "p", "q")))
    by_degree.sort(key=lambda r: r["n"])
    degrees, items = (np.array([float(r[c]) for r in by_degree]) for c in ("n", "items"))
    sizes, records = (np.array([float(r[c]) for r in by_size]) for c in ("k", "records"))
    x, y = fit_null(degrees, items, sizes, records)
    log_degrees, log_x = np.log(degrees), np.log(x)

    def tails(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            # many pairs share their three counts
            low, high = np.minimum(batch["n_a"], batch["n_b"]), np.maximum(batch["n_a"], batch["n_b"])
            own, of = np.unique(np.column_stack([low, high, batch["n_ab"]]).astype(float), axis=0, return_inverse=True)
            xa, xb = (np.exp(np.interp(np.log(own[:, i]), log_degrees, log_x)) for i in (0, 1))
            q = (np.outer(xa, y) / (1 + np.outer(xa, y))) * (np.outer(xb, y) / (1 + np.outer(xb, y)))
            mean = (q * records).sum(axis=1)
            n = own[:, 2]
            p = np.maximum(poisson_binomial_tail(q, records, n), 1e-300)
            of = of.ravel()
            yield batch.assign(esperado=mean[of], veces=(n / mean)[of], p=p[of])

    schema = f"{name}_a string, {name}_b string, n_a long, n_b long, n_ab long, esperado double, veces double, p double"
    tested = pairs.sortWithinPartitions("n_a", "n_b", "n_ab").mapInPandas(tails, schema).withColumn(
        "c", F.least(F.floor(-F.log10("p") / P_STEP), F.lit(P_CLASSES)).cast("int")
    ).checkpoint()
    histogram = {r["c"]: r["count"] for r in tested.groupBy("c").count().collect()}
    n_items = counts.count()
    tests, seen, q, rows = n_items * (n_items - 1) / 2, sum(histogram.values()), 1.0, []
    for c in sorted(histogram):  # from the largest p down
        q = min(q, 10 ** (-c * P_STEP) * tests / seen, 1.0)
        rows.append((c, q))
        seen -= histogram[c]
    values = F.broadcast(tested.sparkSession.createDataFrame(rows, "c int, q double"))  # one row per class
    return tested.join(values, "c").drop("c")
