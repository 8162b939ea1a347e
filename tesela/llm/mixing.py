"""Problem 9: a mix of sources by target shares of its tokens."""

from __future__ import annotations

from heapq import heapify, heappop, heapreplace

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Tokens of a shard, about: a shard is ordered in one task, so this bounds that task.
SHARD_TOKENS = 2_000_000
#: Shards of a source, at most; those of a source beyond SHARD_TOKENS times this are longer. One task apportions the shards of a source.
SHARDS = 20_000
#: Blocks the whole mix is cut into, at least, and blocks in a shard, at least.
BLOCKS, SHARD_BLOCKS = 20_000, 16


def source_name(source: Column) -> Column:
    """A source without regard to case and to blanks at its ends."""
    return F.lower(F.btrim(source, F.lit(" \t ")))


def apportion(weights: dict, blocks: int, caps: dict | None = None) -> dict:
    """Sainte-Laguë: each next block goes to the highest weight / (2 x blocks so far + 1), within caps.

    Keys of no weight or a cap of 0 get none. Ties go to the smaller key. If all caps are reached the
    rest is not given out.

    A key has floor((weight / t + 1) / 2) blocks whose quotient is t or more. The least t at which all keys
    together have no more than there are is found by halving: those blocks come first whatever the order
    of the rest, so they are given at once, and a heap of quotients gives the few that are left.
    """
    given = dict.fromkeys(weights, 0)
    room = {k: (blocks if caps is None else caps[k]) for k, w in weights.items() if w > 0}
    low, high = 0.0, 2.0 * max((weights[k] for k in room), default=0.0)
    for _ in range(100 if blocks > 0 else 0):
        t = (low + high) / 2
        if t <= low or t >= high:
            break
        # a hair under each quotient, so that rounding gives no block that is not due
        due = {k: min(n, int((weights[k] / (t * (1 + 1e-9)) + 1) / 2)) for k, n in room.items()}
        if sum(due.values()) <= blocks:
            high = t
            given.update(due)
        else:
            low = t
    left = blocks - sum(given.values())
    heap = [(-weights[k] / (2 * given[k] + 1), k) for k, n in room.items() if given[k] < n]
    heapify(heap)
    while left > 0 and heap:
        _, k = heap[0]
        given[k] += 1
        left -= 1
        if given[k] < room[k]:
            heapreplace(heap, (-weights[k] / (2 * given[k] + 1), k))
        else:
            heappop(heap)
    return given


def shard_quotas(sizes: DataFrame, sources: dict[str, tuple[int, int, int]], block: float) -> DataFrame:
    """(source, shard, vueltas, resto, tope): how often a shard is in the mix whole, and the tokens it gives besides.

    ``sizes`` (source, shard, t) has the tokens of each shard; ``sources`` the blocks, all tokens and greatest
    repetition of each source. The blocks of a source are apportioned to its shards by their tokens, the
    shards of one source in one task: at most SHARDS rows. Nothing of a shard comes to the driver.
    """

    def quotas(shards: pd.DataFrame) -> pd.DataFrame:
        shards = shards.sort_values("shard")
        name = shards["source"].iloc[0]
        due, have, most = sources[name]
        tokens = dict(zip(shards["shard"].tolist(), shards["t"].tolist()))
        if due * block >= have * most:  # scarce: all of it, whatever the blocks of its shards
            rows = [(name, k, most, 0.0, most) for k in tokens]
        else:
            top = {k: int(t * most // block) + 1 for k, t in tokens.items()}
            rows = []
            for k, n in apportion({k: float(t) for k, t in tokens.items()}, due, top).items():
                quota = min(n * block, float(tokens[k] * most))
                full = min(int(quota // tokens[k]), most)
                rows.append((name, k, full, quota - full * tokens[k], most))
        return pd.DataFrame(rows, columns=["source", "shard", "vueltas", "resto", "tope"])

    return sizes.groupBy("source").applyInPandas(quotas, "source string, shard int, vueltas int, resto double, tope int")


def mix(
    sized: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 7, blocks: int = BLOCKS,
    shard_tokens: int = SHARD_TOKENS,
) -> tuple[DataFrame, DataFrame]:
    """(records of the mix, report by source) of ``sized`` (doc_id, source, n_tokens).

    ``targets`` (source, cuota, max_repeticiones) is a small fixed table and read by the driver. The
    total is, unless given, all tokens of the sources with a target; shares of sources without any
    tokens go to the others in proportion. It is cut into equal blocks, ``blocks`` or more, so that a shard
    has SHARD_BLOCKS at least; they are apportioned to the sources and
    then, for each source, to shards of about ``shard_tokens``. A source too scarce for its blocks gives
    all its records at their full repetitions; what it lacks is not given to others, who have their
    blocks already, so the mix is smaller by it and ``cuota_real`` tells the shares that result.
    In a shard the records follow in an order drawn by ``seed``; a quota of several times the shard's
    tokens repeats all of it, and the rest takes the first records whose running sum comes nearest.
    A source of one third of all rows so is spread over many tasks. Records of a null or unknown source,
    and those without tokens, are not in the mix. Equal doc_ids are records of their own.

    Records: doc_id, source, n_tokens, repeticiones. Report: source, cuota, max_repeticiones,
    tokens_disponibles, documentos, tokens_mezcla, cuota_real, repeticion_maxima.
    """
    goals = {
        r["s"]: (float(r["cuota"]), int(r["m"]))
        for r in targets.select(source_name(F.col("source")).alias("s"), "cuota", F.coalesce("max_repeticiones", F.lit(1)).alias("m")).collect()
        if r["s"] and r["cuota"] and r["cuota"] > 0
    }
    clean = sized.select("doc_id", source_name(F.col("source")).alias("source"), F.col("n_tokens").cast("long").alias("n_tokens"))
    clean = clean.where(F.col("source").isin(list(goals)) & (F.col("n_tokens") > 0)).checkpoint()
    spark = sized.sparkSession
    have = {r["source"]: r["t"] for r in clean.groupBy("source").agg(F.sum("n_tokens").alias("t")).collect()}
    weights = {s: goals[s][0] for s in have}
    total = total_tokens or sum(have.values())
    # shards: their number follows the size of the source
    shards = {s: min(SHARDS, max(1, -(-t // shard_tokens))) for s, t in have.items()}
    least = min((t / shards[s] for s, t in have.items() if shards[s] > 1), default=float(total))
    block = max(1.0, min(total / blocks, least / SHARD_BLOCKS)) if have else 1.0
    given = apportion(weights, round(total / block))
    n_shards = F.create_map(*(F.lit(x) for kv in shards.items() for x in kv)) if shards else F.create_map(F.lit(""), F.lit(1))
    placed = clean.withColumn("orden", F.xxhash64(F.lit(seed), "doc_id", "n_tokens")).withColumn(
        "shard", F.pmod(F.xxhash64(F.lit(seed + 1), "orden"), n_shards[F.col("source")]).cast("int")
    )
    sizes = placed.groupBy("source", "shard").agg(F.sum("n_tokens").alias("t"))
    plan = shard_quotas(sizes, {s: (given[s], have[s], goals[s][1]) for s in have}, block)
    order = Window.partitionBy("source", "shard").orderBy("orden", "doc_id", "n_tokens")
    running = F.sum("n_tokens").over(order.rowsBetween(Window.unboundedPreceding, 0))
    # the record that passes the rest is taken if at least half of it is within
    taken = (running - F.col("n_tokens") / 2.0 <= F.col("resto")) & (F.col("vueltas") < F.col("tope"))
    records = (
        placed.join(plan, ["source", "shard"])  # the keys that the window is parted by
        .withColumn("repeticiones", F.col("vueltas") + taken.cast("int"))
        .where("repeticiones > 0")
        .select("doc_id", "source", "n_tokens", "repeticiones")
    )
    used = records.groupBy("source").agg(
        F.count(F.lit(1)).alias("documentos"), F.sum(F.col("n_tokens") * F.col("repeticiones")).alias("tokens_mezcla"),
        F.max("repeticiones").alias("repeticion_maxima"),
    )
    rows = [(s, c, m, int(have.get(s, 0))) for s, (c, m) in goals.items()]
    goal_rows = spark.createDataFrame(rows, "source string, cuota double, max_repeticiones int, tokens_disponibles long")
    report = goal_rows.join(used, "source", "left").select(
        "source", "cuota", "max_repeticiones", "tokens_disponibles",
        *(F.coalesce(c, F.lit(0)).cast(k).alias(c) for c, k in (("documentos", "long"), ("tokens_mezcla", "long"), ("repeticion_maxima", "int"))),
    )
    everything = Window.partitionBy()  # one row per target
    return records, report.withColumn("cuota_real", F.col("tokens_mezcla") / F.greatest(F.sum("tokens_mezcla").over(everything), F.lit(1)))
