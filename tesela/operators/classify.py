"""Descending hierarchical classification, stability over two thresholds, agreement of partitions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesela.functions.distributions import CHI2_95

#: Non-zero cells of one tree node that its kernel takes, at most; a larger node is cut by joins (large_cut).
#: A cell takes about 30 bytes there.
NODE_CELLS = 25_000_000
#: A node of at most so many cells is cut down to its leaves by the kernel that made it; larger ones are tasks of their own.
INLINE_CELLS = 15_000_000
#: Cells that a step over all cells of a node holds as doubles at once.
CHUNK = 1_000_000
#: Cells that a step made again and again takes at once, so that what it needs stays in the processor's cache.
CACHED = 65_536
#: Terms whose products with each other are held in one square table at most (first_factor), and pairs made at once for it.
GRAM_TERMS, GRAM_PAIRS = 4096, 4_000_000
#: Units whose swaps are decided at once, at most and at least.
SWAP_UNITS = (4096, 64)


def by_units(rows: np.ndarray, cols: np.ndarray, weights: np.ndarray | None, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray | None, np.ndarray]:
    """(columns, weights, units that have cells, first cell of each and the end): cells in the order of their units."""
    if np.any(rows[1:] < rows[:-1]):
        order = np.argsort(rows, kind="stable")
        rows, cols, weights = rows[order], cols[order], None if weights is None else weights[order]
    starts = np.searchsorted(rows, np.arange(n + 1))
    filled = np.flatnonzero(np.diff(starts))
    return cols, weights, filled, np.append(starts[filled], len(rows))


def gram(cols: np.ndarray, weights: np.ndarray | None, starts: np.ndarray, r: np.ndarray, m: int) -> np.ndarray:
    """Terms by terms: the sum over units of the products of their cells, each unit divided by its ``r``. Units have ``starts`` and cells."""
    out, sizes = np.zeros(m * m), np.diff(starts)
    held, shares, count = [], [], 0

    def add() -> None:
        np.add(out, np.bincount(np.concatenate(held), np.concatenate(shares), m * m), out=out)

    for k in np.unique(sizes):
        left, right = np.triu_indices(k)
        units = np.flatnonzero(sizes == k)
        step = max(1, GRAM_PAIRS // len(left))
        for at in range(0, len(units), step):
            some = units[at : at + step]
            place = starts[some][:, None] + np.arange(k)
            t = cols[place].astype(np.intp)
            a, b = t[:, left], t[:, right]
            value = np.broadcast_to((1 / r[some])[:, None], a.shape)
            if weights is not None:
                value = value * weights[place][:, left] * weights[place][:, right]
            held.append((a * m + b).ravel())
            shares.append(value.ravel())
            count += a.size
            if count >= GRAM_PAIRS:
                add()
                held, shares, count = [], [], 0
    if held:
        add()
    half = out.reshape(m, m)
    diagonal = half.diagonal().copy()
    half = half + half.T
    np.fill_diagonal(half, diagonal)
    return half


def first_factor(rows: np.ndarray, cols: np.ndarray, weights: np.ndarray | None, n: int, m: int, pseudo: float = 0.01, steps: int = 100, start: np.ndarray | None = None) -> np.ndarray:
    """First factor of a sparse table by reciprocal averaging, centred and of length 1, with a fixed sign.

    ``pseudo`` is added to the margins only. The sign is that which makes the coordinate of largest size positive,
    so that the order of classes does not hang on the start, which is drawn, or given as :func:`warm_start` makes it.
    Without ``weights`` every cell weighs 1. Cells are gone through by whole units and by few enough to stay in the
    processor's cache, so that no array of doubles holds them all. Where there are few terms and many cells, the rounds
    are made on the terms by the table of their products (:func:`gram`): the same rounds, and the cells are gone through
    only at the end and where the coordinates hardly change any more, to test them as in the other way.
    """
    cols, weights, filled, starts = by_units(rows, cols, weights, n)
    places = np.arange(0, len(cols), max(CACHED, 4 * m))
    cuts = np.unique(np.append(np.searchsorted(starts[:-1], places), len(filled)))
    parts = [(slice(int(a), int(b)), slice(int(starts[a]), int(starts[b])), starts[a:b] - starts[a], np.diff(starts[a : b + 1])) for a, b in zip(cuts[:-1], cuts[1:])]

    def by_row(of: np.ndarray | None) -> np.ndarray:
        sums = np.zeros(len(filled))
        for own, cells, firsts, sizes in parts:
            if of is None and weights is None:
                sums[own] = sizes
                continue
            values = weights[cells] if of is None else of[cols[cells]] if weights is None else weights[cells] * of[cols[cells]]
            sums[own] = np.add.reduceat(values, firsts)
        out = np.zeros(n)
        out[filled] = sums
        return out

    def by_column(of: np.ndarray | None) -> np.ndarray:
        out = np.zeros(m)
        own_values = None if of is None else of[filled]
        for own, cells, _, sizes in parts:
            values = None if own_values is None else np.repeat(own_values[own], sizes)
            if weights is not None:
                values = weights[cells] if values is None else weights[cells] * values
            out += np.bincount(cols[cells], values, m)
        return out

    r, c = by_row(None) + pseudo * m, by_column(None) + pseudo * n
    r[r == 0], c[c == 0] = 1, 1
    mass = r / r.sum()
    x = np.random.default_rng(42).standard_normal(n) if start is None else np.array(start, dtype=float)
    x -= (mass * x).sum()
    x /= max(np.linalg.norm(x), 1e-12)
    pairs = int((np.diff(starts) ** 2).sum())
    if m <= GRAM_TERMS and m * m <= 4 * len(cols) and pairs <= steps * len(cols) / 2:
        products, plain = gram(cols, weights, starts, r[filled], m), by_column(np.ones(n))
        whole, z, made, norm = r.sum(), by_column(x) / c, 1, None

        def coordinates() -> np.ndarray:
            y = by_row(z) / r
            return y - (mass * y).sum()

        while made < steps:  # z is what the units' coordinates of the round ``made`` come from, but for its length
            # the mean of a round's coordinates by mass is the sum of the cells' values
            new = (products @ z - plain.dot(z) / whole * plain) / c
            length = np.abs(new).max()
            if length < 1e-12 * np.abs(z).max() or length < 1e-300:
                break
            new /= length
            old, z, made = z / max(np.abs(z).max(), 1e-300), new, made + 1
            gap = min(np.abs(new - old).max(), np.abs(new + old).max())
            if gap < 2e-8 * np.sqrt(n):  # the most that coordinates from terms of at most 1 can be in length
                norm = np.linalg.norm(coordinates()) if norm is None else norm
                if gap < 1.5e-8 * norm:
                    break
        x = coordinates()
        length = np.linalg.norm(x)
        if length < 1e-12 * max(np.abs(z).max(), 1e-300):
            return np.zeros(n)
        x /= length
        steps -= made
    for _ in range(steps):
        y = by_row(by_column(x) / c) / r
        y -= (mass * y).sum()
        length = np.linalg.norm(y)
        if length < 1e-12:
            return np.zeros(n)
        y /= length
        done = min(np.abs(y - x).max(), np.abs(y + x).max()) < 1e-8
        x = y
        if done:
            break
    return x if x[np.abs(x).argmax()] > 0 else -x


def warm_start(vectors: np.ndarray, steps: int = 20) -> np.ndarray | None:
    """Coordinates of units on the first principal axis of their vectors, by ``steps`` power iterations; None for fewer than five units or vectors all zero."""
    if len(vectors) < 5 or not np.any(vectors):
        return None
    x = vectors - vectors.mean(axis=0)
    axis = np.random.default_rng(42).standard_normal(x.shape[1])
    for _ in range(steps):
        axis = x.T @ (x @ axis)
        length = np.linalg.norm(axis)
        if length < 1e-12:
            return None
        axis /= length
    return x @ axis


def best_cut(x: np.ndarray) -> tuple[np.ndarray, float]:
    """(whether each point is right of the best cut, R squared): most sum of squares between, the first if tied."""
    order = np.argsort(x, kind="stable")
    s = x[order]
    n = len(s)
    left = np.cumsum(s)[:-1]
    k = np.arange(1, n)
    total = s.sum()
    between = left**2 / k + (total - left) ** 2 / (n - k) - total**2 / n
    at = int(between.argmax())
    whole = ((s - s.mean()) ** 2).sum()
    right = np.zeros(n, dtype=bool)
    right[order[at + 1 :]] = True
    return right, float(between[at] / whole) if whole > 0 else 0.0


def swap(rows: np.ndarray, cols: np.ndarray, n: int, m: int, right: np.ndarray, passes: int = 2, vectors: np.ndarray | None = None) -> np.ndarray:
    """Units change sides one by one while the chi-square of side by term grows; no side is emptied.

    Only the terms of the unit enter its difference. With ``vectors``, a difference of at most 0.5 either
    way is decided by the nearer mean vector.
    """
    if vectors is None:
        return swap_at_once(rows, cols, n, m, right, passes)
    right = right.copy()
    if np.any(rows[1:] < rows[:-1]):
        order = np.argsort(rows, kind="stable")
        rows, cols = rows[order], cols[order]
    starts = np.searchsorted(rows, np.arange(n + 1)).tolist()
    right_count, total = np.zeros(m), np.zeros(m)
    for k in range(0, len(rows), CHUNK):
        part = slice(k, k + CHUNK)
        right_count += np.bincount(cols[part], right[rows[part]], m)
        total += np.bincount(cols[part], None, m)
    share = 1 / np.maximum(total, 1)
    size = [int((~right).sum()), int(right.sum())]
    whole = size[0] + size[1]
    sums = np.array([vectors[~right].sum(axis=0), vectors[right].sum(axis=0)])

    # With c of t units right, p of all units and q = 1 - p, the chi-square of a term is (c - p t)^2 / (t p q); over the
    # terms of a unit that is (sum c^2 / t - 2 p sum c + p^2 sum t) / (p q).
    for _ in range(passes):
        moved = False
        for i in range(n):
            side = int(right[i])
            lo, hi = starts[i], starts[i + 1]
            if size[side] <= 1 or lo == hi:
                continue
            t = cols[lo:hi]
            c, h = right_count[t], share[t]
            step = -1.0 if side else 1.0
            ch = c * h
            square, plain, every = float(ch.dot(c)), float(c.sum()), float(total[t].sum())
            p, p_new = size[1] / whole, (size[1] + step) / whole
            old = (square - 2 * p * plain + p * p * every) / (p * (1 - p)) if size[1 - side] else 0.0
            new = square + 2 * step * float(ch.sum()) + float(h.sum()) - 2 * p_new * (plain + step * (hi - lo)) + p_new * p_new * every
            gain = new / (p_new * (1 - p_new)) - old
            if abs(gain) <= 0.5:
                norm = np.linalg.norm(sums, axis=1)
                cosine = (sums @ vectors[i]) / np.maximum(norm, 1e-12)
                go = cosine[1 - side] > cosine[side]
            else:
                go = gain > 0.5 + 1e-9 * (1 + abs(old))  # a difference of rounding is none
            if go:
                right_count[t] = c + step
                size[side] -= 1
                size[1 - side] += 1
                right[i], moved = not side, True
                sums[side] -= vectors[i]
                sums[1 - side] += vectors[i]
        if not moved:
            break
    return right


def swap_at_once(rows: np.ndarray, cols: np.ndarray, n: int, m: int, right: np.ndarray, passes: int = 2, most: int = SWAP_UNITS[0], least: int = SWAP_UNITS[1]) -> np.ndarray:
    """:func:`swap` without vectors, with the same moves, many units at a time.

    What a unit does hangs on the moves before it. The moves of a block are guessed, each unit is decided anew
    with the counts that the guessed moves before it leave, and so on until nothing changes: then every unit was
    decided as one by one. Each round makes at least one more unit right; where a block does not settle in a few
    rounds, its units up to the first that changed are taken as they are and a smaller block begins after them.
    """
    right = right.copy()
    cols, _, filled, starts = by_units(rows, cols, None, n)
    right_count, total = np.zeros(m), np.zeros(m)
    sizes = np.diff(starts)
    for k in range(0, len(filled), most):
        own, cells = slice(k, k + most), cols[starts[k] : starts[min(k + most, len(filled))]]
        right_count += np.bincount(cells, np.repeat(right[filled[own]].astype(float), sizes[own]), m)
        total += np.bincount(cells, None, m)
    share = 1 / np.maximum(total, 1)
    whole, on_right = len(right), int(right.sum())

    for _ in range(passes):
        moved, at, width = False, 0, most
        while at < len(filled):
            end = min(at + width, len(filled))
            units, size, firsts = filled[at:end], sizes[at:end], starts[at:end] - starts[at]
            t = cols[starts[at] : starts[end]]
            base, h, side = right_count[t], share[t], right[units]
            step = np.where(side, -1.0, 1.0)
            every, shares = np.add.reduceat(total[t], firsts), np.add.reduceat(h, firsts)

            def decide(c: np.ndarray, n1: np.ndarray) -> np.ndarray:
                # the chi-square of the terms of a unit before and after its move, as in swap
                ch = c * h
                square, plain, mixed = np.add.reduceat(ch * c, firsts), np.add.reduceat(c, firsts), np.add.reduceat(ch, firsts)
                p, q = n1 / whole, (n1 + step) / whole
                with np.errstate(divide="ignore", invalid="ignore"):
                    old = np.where((n1 > 0) & (n1 < whole), (square - 2 * p * plain + p * p * every) / (p * (1 - p)), 0.0)
                    new = (square + 2 * step * mixed + shares - 2 * q * (plain + step * size) + q * q * every) / (q * (1 - q))
                    gain = new - old
                return (np.where(side, n1, whole - n1) > 1) & (gain > 1e-9 * (1 + np.abs(old)))

            go = decide(base, np.full(len(units), float(on_right)))
            done = len(units)
            if go.any():
                order = np.argsort(t.astype(np.uint16) if m <= 65_536 else t, kind="stable")  # small numbers are sorted in fewer steps
                first = np.flatnonzero(np.diff(t[order], prepend=-1))
                run = np.diff(np.append(first, len(t)))
                for turn in range(20):
                    change = step * go
                    each = np.repeat(change, size)[order]
                    before = np.cumsum(each) - each
                    c = np.empty(len(t))
                    c[order] = before - np.repeat(before[first], run)
                    again = decide(base + c, on_right + np.cumsum(change) - change)
                    if np.array_equal(again, go):
                        break
                    if turn == 19:
                        done = int((again != go).argmax()) + 1
                    go = again
                width = most if done == len(units) else max(least, width // 2)
                gone = np.flatnonzero(go[:done])
                if len(gone):
                    moved = True
                    right[units[gone]] = ~right[units[gone]]
                    on_right += int(step[gone].sum())
                    cells = np.repeat(np.where(go, step, 0.0)[:done], size[:done])
                    right_count += np.bincount(t[: len(cells)], cells, m)
            at += done
        if not moved:
            break
    return right


def best_cut_of(rows: DataFrame, unit: str) -> tuple[float, float] | None:
    """(least coordinate right of the best cut, R squared) of (unit, x): every cut is tried, whatever their number.

    The rows are sorted by ranges; each task runs along its own with the counts and sums of those before, and sends
    its best cut: one row from each. None where all coordinates are equal.
    """
    placed = rows.select(unit, "x").orderBy("x", unit).withColumn("_p", F.spark_partition_id()).checkpoint()
    parts = sorted((r["_p"], r["n"], r["s"], r["q"], r["least"], r["most"]) for r in placed.groupBy("_p").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"), F.min("x").alias("least"), F.max("x").alias("most")).collect())
    if not parts or parts[-1][5] <= parts[0][4]:
        return None
    n, total = sum(p[1] for p in parts), sum(p[2] for p in parts)
    before, k, s = {}, 0, 0.0
    for p, size, part, *_ in parts:
        before[p] = (k, s)
        k, s = k + size, s + part

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best, at, state = -np.inf, None, None
        for batch in batches:
            if not len(batch):
                continue
            x = batch["x"].to_numpy()
            k0, s0 = before[int(batch["_p"].iloc[0])] if state is None else state
            # a cut stands before a unit: what is left of it are those before
            k, left = k0 + np.arange(len(x)), s0 + np.concatenate([[0.0], np.cumsum(x)[:-1]])
            state = (k0 + len(x), s0 + x.sum())
            with np.errstate(divide="ignore", invalid="ignore"):
                between = np.where(k > 0, left**2 / k + (total - left) ** 2 / (n - k) - total**2 / n, -np.inf)
            i = int(between.argmax())
            if between[i] > best:
                best, at = float(between[i]), float(x[i])
        yield pd.DataFrame({"b": [best] if at is not None else [], "x": [at] if at is not None else []}).astype(float)

    found = placed.sortWithinPartitions("x", unit).mapInPandas(run, "b double, x double").collect()
    between, border = max((r["b"], -r["x"]) for r in found)
    whole = sum(p[3] for p in parts) - total**2 / n
    return -border, between / whole if whole > 0 else 0.0


def large_cut(cells: DataFrame, unit: str, least: int, min_r2: float = 0.05, passes: int = 2, pseudo: float = 0.01, rounds: int = 100) -> DataFrame | None:
    """(unit, right) of a node too large for a kernel, or None if it is a leaf.

    The first factor is the same reciprocal averaging to the same tolerance and number of rounds, with two joins a
    round, written to the checkpoint folder, and every cut of the axis is tried. Swaps are made for all units at once
    in each pass and not one by one, so the result can differ from a kernel's in single units near the border.
    """
    rows = cells.groupBy(unit).agg(F.sum("w").alias("r"))
    cols = cells.groupBy("t").agg(F.sum("w").alias("c"))
    n, m = rows.count(), cols.count()
    if n < 2 * least or m < 2:
        return None
    start = F.pmod(F.xxhash64(unit, F.lit(42)), F.lit(1 << 30)) / float(1 << 29) - 1
    filled = lambda c: F.when(c == 0, 1.0).otherwise(c)
    rows = rows.select(unit, filled(F.col("r") + pseudo * m).alias("r"), start.alias("x")).checkpoint()
    cols = cols.select("t", filled(F.col("c") + pseudo * n).alias("c")).checkpoint()
    for _ in range(rounds):
        z = cells.join(rows.select(unit, "x"), unit).groupBy("t").agg(F.sum(F.col("w") * F.col("x")).alias("s"))
        z = z.join(cols, "t").select("t", (F.col("s") / F.col("c")).alias("z"))
        y = cells.join(z, "t").groupBy(unit).agg(F.sum(F.col("w") * F.col("z")).alias("s")).join(rows, unit)
        y = y.select(unit, "r", "x", (F.col("s") / F.col("r")).alias("y")).checkpoint()
        mass, first, size, plain, square = y.agg(F.sum("r"), F.sum(F.col("r") * F.col("y")), F.count(F.lit(1)), F.sum("y"), F.sum(F.col("y") * F.col("y"))).first()
        mean = first / mass
        length = np.sqrt(max(square - 2 * mean * plain + size * mean * mean, 0.0))
        if length < 1e-12:
            return None
        new = (F.col("y") - mean) / length
        same, turned = y.agg(F.max(F.abs(new - F.col("x"))), F.max(F.abs(new + F.col("x")))).first()
        rows = y.select(unit, "r", new.alias("x"))
        if min(same, turned) < 1e-8:
            break
    found = best_cut_of(rows, unit)
    if found is None:
        return None
    border, r2 = found
    if n * r2 < 3.84 or r2 < min_r2:
        return None
    sides = rows.select(unit, (F.col("x") >= border).alias("right"))
    present = cells.where("w > 0").select(unit, "t")
    for _ in range(passes):
        sides = sides.checkpoint()
        sizes = {r["right"]: r["count"] for r in sides.groupBy("right").count().collect()}
        n0, n1 = float(sizes.get(False, 0)), float(sizes.get(True, 0))
        if min(n0, n1) <= 1:
            break
        counts = present.join(sides, unit).groupBy("t").agg(F.count_if(~F.col("right")).alias("c0"), F.count_if("right").alias("c1"))

        def chi(c0, c1, a, b):
            t = c0 + c1
            e0, e1 = t * (a / (a + b)), t * (b / (a + b))
            return F.pow(c0 - e0, 2) / F.greatest(e0, F.lit(1e-12)) + F.pow(c1 - e1, 2) / F.greatest(e1, F.lit(1e-12))

        c0, c1 = F.col("c0").cast("double"), F.col("c1").cast("double")
        old = chi(c0, c1, n0, n1)
        gain = F.when(F.col("right"), chi(c0 + 1, c1 - 1, n0 + 1, n1 - 1) - old).otherwise(chi(c0 - 1, c1 + 1, n0 - 1, n1 + 1) - old)
        gains = present.join(sides, unit).join(counts, "t").groupBy(unit).agg(F.sum(gain).alias("g"))
        sides = sides.join(gains, unit, "left").select(unit, F.when(F.col("g") > 0, ~F.col("right")).otherwise(F.col("right")).alias("right"))
    sides = sides.checkpoint()
    sizes = [r["count"] for r in sides.groupBy("right").count().collect()]
    return sides if len(sizes) == 2 and min(sizes) >= least else None


def compact(cols: np.ndarray) -> tuple[np.ndarray, int]:
    """Columns numbered from 0 without gaps, in their order, and how many there are."""
    used = np.zeros(int(cols.max()) + 1 if len(cols) else 0, dtype=bool)
    used[cols] = True
    number = np.cumsum(used, dtype=np.int32) - 1
    out = np.empty(len(cols), dtype=np.int32)
    for k in range(0, len(cols), CHUNK):
        out[k : k + CHUNK] = number[cols[k : k + CHUNK]]
    return out, int(used.sum())


def cut_node(rows: np.ndarray, cols: np.ndarray, weights: np.ndarray | None, n: int, m: int, least: int, min_r2: float, passes: int, pseudo: float) -> np.ndarray | None:
    """Whether each unit of a node goes right, or None if it is a leaf: first factor, best cut, test, swaps."""
    if n < 2 * least or m < 2:
        return None
    right, r2 = best_cut(first_factor(rows, cols, weights, n, m, pseudo))
    if n * r2 < 3.84 or r2 < min_r2:
        return None
    present = slice(None) if weights is None or weights.min() > 0 else weights > 0
    right = swap(rows[present], cols[present], n, m, right, passes)
    return right if min(right.sum(), n - right.sum()) >= least else None


def grown(node: str, rows: np.ndarray, cols: np.ndarray, weights: np.ndarray | None, n: int, cut, max_depth: int, inline: int) -> tuple[np.ndarray, np.ndarray]:
    """(node of each unit, whether it is a leaf): the node is cut, and the parts of at most ``inline`` cells down to their leaves."""
    label, leaf = np.full(n, node, dtype=object), np.zeros(n, dtype=bool)
    stack = [(node, None, rows, cols, weights)]
    while stack:
        name, members, rows, cols, weights = stack.pop()
        size = n if members is None else len(members)
        cols, m = compact(cols)
        right = cut(rows, cols, weights, size, m) if len(name) <= max_depth else None
        if right is None:
            if members is None:
                leaf[:] = True
            else:
                leaf[members] = True
            continue
        for side in (False, True):
            here = right == side
            child, own = name + str(int(side)), np.flatnonzero(here) if members is None else members[here]
            label[own] = child
            cells = here[rows]
            if np.count_nonzero(cells) <= inline:
                number = np.cumsum(here, dtype=np.int32) - 1
                stack.append((child, own, number[rows[cells]], cols[cells], None if weights is None else weights[cells]))
    return label, leaf


def cdh(incidence: DataFrame, unit: str, term: str = "termino", min_share: float = 0.1, min_size: int = 5, max_depth: int = 10, min_r2: float = 0.05, passes: int = 2, pseudo: float = 0.01, weight: str | None = None, node_cells: int = NODE_CELLS, inline_cells: int = INLINE_CELLS) -> tuple[DataFrame, list[tuple]]:
    """Descending hierarchical classification of the (unit, term) table.

    Returns ((unit, nodo, clase), tree rows (nodo, padre, profundidad, n, hoja)). A unit's terms are packed in one
    row, written once to the checkpoint folder. Each round cuts all open nodes at once, a node in one kernel
    (:func:`cut_node`): first factor, best cut, test (n R^2 of at least 3.84 and R^2 of at least ``min_r2``), swaps.
    Parts of at most ``inline_cells`` cells are cut down to their leaves there, larger ones in the next round with
    a task for each. A node of more than ``node_cells`` cells goes to :func:`large_cut` instead, so that no task
    holds it. A part under the least size makes its node a leaf. Classes are numbered in the order of the leaves
    from left to right.
    """
    fields = [F.xxhash64(term).alias("t"), *([F.col(weight).cast("double").alias("w")] if weight else [])]
    packed = incidence.groupBy(unit).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("c"))
    written = packed.select(unit, F.col("c.t").alias("t"), *([F.col("c.w").alias("w")] if weight else [])).checkpoint()
    return cdh_packed(written, unit, min_share, min_size, max_depth, min_r2, passes, pseudo, node_cells, inline_cells)


def term_counts(packed: DataFrame, unit: str, min_units: int = 3, most: int = 500_000) -> DataFrame:
    """(t, n): hashes of the terms in ``min_units`` units or more of (unit, t array of different hashes).

    Written once; broadcast if it has at most ``most`` rows, so that no cells are shuffled by term.
    """
    kept = packed.select(F.explode("t").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_units).checkpoint()
    return F.broadcast(kept) if kept.count() <= most else kept


def with_terms(packed: DataFrame, unit: str, terms: DataFrame) -> DataFrame:
    """(unit, t) with those of the hashes alone that are in ``terms`` (t), in order, written once; units without any are left out."""
    cells = packed.select(unit, F.explode("t").alias("t")).join(terms.select("t"), "t", "left_semi")
    return cells.groupBy(unit).agg(F.sort_array(F.collect_list("t")).alias("t")).checkpoint()


def cdh_packed(packed: DataFrame, unit: str, min_share: float = 0.1, min_size: int = 5, max_depth: int = 10, min_r2: float = 0.05, passes: int = 2, pseudo: float = 0.01, node_cells: int = NODE_CELLS, inline_cells: int = INLINE_CELLS) -> tuple[DataFrame, list[tuple]]:
    """:func:`cdh` of units packed in one row each: t, an array of the hashes of its terms, and w, their weights, if there are any.

    The table is read several times, so it should be written before.
    """
    spark = packed.sparkSession
    kind = dict(packed.dtypes)[unit]
    weight = "w" in packed.columns
    rest = packed.select(unit, F.lit("0").alias("nodo"), F.lit(False).alias("hoja"), "t", F.col("w") if weight else F.lit(None).cast("array<double>").alias("w"))
    n_all = rest.count()
    least = max(min_size, int(n_all * min_share))
    schema = f"`{unit}` {kind}, nodo string, hoja boolean"

    def cut(rows: np.ndarray, cols: np.ndarray, weights: np.ndarray | None, n: int, m: int) -> np.ndarray | None:
        return cut_node(rows, cols, weights, n, m, least, min_r2, passes, pseudo)

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units, sizes, terms, weights = [], [], [], []
        for batch in batches:
            units.append(batch.column(unit))
            t = batch.column("t")
            sizes.append(np.diff(t.offsets.to_numpy()).astype(np.int64))
            terms.append(t.flatten().to_numpy().copy())
            if weight:
                weights.append(batch.column("w").flatten().to_numpy().copy())
        vocabulary = np.unique(np.concatenate([np.unique(t) for t in terms]))
        for k, t in enumerate(terms):
            terms[k] = np.searchsorted(vocabulary, t).astype(np.int32)
        size, cols, w = np.concatenate(sizes), np.concatenate(terms), np.concatenate(weights) if weight else None
        del terms, weights
        name = pa.concat_arrays(units)
        order = pc.sort_indices(name).to_numpy().astype(np.int64)
        # cells in the order of the units
        n, start = len(size), np.concatenate([[0], np.cumsum(size)[:-1]])
        rows, by_unit = np.repeat(np.arange(n, dtype=np.int32), size[order]), np.empty(len(cols), dtype=np.int32)
        by_weight, at = None if w is None else np.empty(len(cols)), 0
        for k in range(0, n, CHUNK // 10):
            some = order[k : k + CHUNK // 10]
            own = size[some]
            place = np.repeat(start[some] - np.concatenate([[0], np.cumsum(own)[:-1]]), own) + np.arange(own.sum())
            by_unit[at : at + len(place)] = cols[place]
            if w is not None:
                by_weight[at : at + len(place)] = w[place]
            at += len(place)
        del cols, w
        label, leaf = grown(key[0].as_py(), rows, by_unit, by_weight, n, cut, max_depth, inline_cells)
        yield pa.RecordBatch.from_arrays([name.take(pa.array(order)), pa.array(label, pa.string()), pa.array(leaf)], [unit, "nodo", "hoja"])

    done = None
    while True:
        nodes = {r["nodo"]: r["n"] for r in rest.groupBy("nodo").agg(F.sum(F.size("t")).alias("n")).collect()}  # at most 1 / min_share rows
        if not nodes:
            break
        large = sorted(k for k, n in nodes.items() if n > node_cells)
        parts = []
        for node in large:
            own = rest.where(F.col("nodo") == node)
            cells = own.select(unit, F.explode(F.arrays_zip("t", "w") if weight else F.transform("t", lambda t: F.struct(t.alias("t"), F.lit(1.0).alias("w")))).alias("c")).select(unit, "c.t", "c.w").checkpoint()
            sides = large_cut(cells, unit, least, min_r2, passes, pseudo) if len(node) <= max_depth else None
            if sides is None:
                parts.append(own.select(unit, "nodo", F.lit(True).alias("hoja")))
            else:
                parts.append(sides.select(unit, F.when(F.col("right"), node + "1").otherwise(node + "0").alias("nodo"), F.lit(False).alias("hoja")))
        if len(large) < len(nodes):
            parts.append(rest.where(~F.col("nodo").isin(large)).select(unit, "nodo", "t", "w").groupBy("nodo").applyInArrow(run, schema))
        cut_now = parts[0]
        for part in parts[1:]:
            cut_now = cut_now.unionByName(part)
        cut_now = cut_now.checkpoint()
        leaves = cut_now.where("hoja").select(unit, "nodo")
        done = leaves if done is None else done.unionByName(leaves)
        if not cut_now.where("not hoja").take(1):
            break
        rest = rest.select(unit, "t", "w").join(cut_now.where("not hoja"), unit).select(unit, "nodo", "hoja", "t", "w").checkpoint()
    if done is None:
        done = rest.select(unit, "nodo")
    sizes = {r["nodo"]: r["count"] for r in done.groupBy("nodo").count().collect()}  # at most 1 / min_share rows
    tree = {}
    for leaf, n in sizes.items():
        for k in range(1, len(leaf) + 1):
            node = leaf[:k]
            before = tree.get(node, (0, 0, 0, 0))[3]
            tree[node] = (node, node[:-1] or None, k - 1, before + n, k == len(leaf))
    tree = tree or {"0": ("0", None, 0, 0, True)}
    names = spark.createDataFrame([(k, i) for i, k in enumerate(sorted(k for k, v in tree.items() if v[4]))], "nodo string, clase int")
    return done.join(F.broadcast(names), "nodo").select(unit, "nodo", "clase"), [v for _, v in sorted(tree.items())]


def overlap(a: DataFrame, b: DataFrame, unit: str, label_a: str, label_b: str) -> DataFrame:
    """Units in each pair of classes of two partitions."""
    return a.select(unit, F.col(label_a).alias("clase_1")).join(b.select(unit, F.col(label_b).alias("clase_2")), unit).groupBy("clase_1", "clase_2").agg(F.count(F.lit(1)).alias("n"))


def hungarian(gain: np.ndarray) -> list[tuple[int, int]]:
    """One-to-one pairs of rows and columns with the greatest sum, by shortest augmenting paths."""
    flip = gain.shape[0] > gain.shape[1]
    cost = -(gain.T if flip else gain).astype(float)
    n, m = cost.shape
    u, v, match = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, dtype=int)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, way, used = np.full(m + 1, np.inf), np.zeros(m + 1, dtype=int), np.zeros(m + 1, dtype=bool)
        while True:
            used[j0] = True
            i0, step, j1 = match[j0], np.inf, 0
            for j in range(1, m + 1):
                if not used[j]:
                    now = cost[i0 - 1, j - 1] - u[i0] - v[j]
                    if now < least[j]:
                        least[j], way[j] = now, j0
                    if least[j] < step:
                        step, j1 = least[j], j
            for j in range(m + 1):
                if used[j]:
                    u[match[j]] += step
                    v[j] -= step
                else:
                    least[j] -= step
            j0 = j1
            if match[j0] == 0:
                break
        while j0:
            match[j0], j0 = match[way[j0]], way[j0]
    pairs = [(int(match[j]) - 1, j - 1) for j in range(1, m + 1) if match[j]]
    return sorted((b, a) if flip else (a, b) for a, b in pairs)


def matched_classes(table: DataFrame) -> list[tuple]:
    """Classes of two partitions paired one to one for the greatest overlap; the table has a row per pair of classes."""
    rows = table.collect()
    left, right = sorted({r["clase_1"] for r in rows}), sorted({r["clase_2"] for r in rows})
    gain = np.zeros((len(left), len(right)))
    for r in rows:
        gain[left.index(r["clase_1"]), right.index(r["clase_2"])] = r["n"]
    return [(left[i], right[j]) for i, j in hungarian(gain)] if rows else []


def stable_units(a: DataFrame, b: DataFrame, unit: str, label_a: str, label_b: str) -> DataFrame:
    """unit, clase (of the first partition), estable: whether its two classes are paired."""
    pairs = matched_classes(overlap(a, b, unit, label_a, label_b))
    joined = a.select(unit, F.col(label_a).alias("clase")).join(b.select(unit, F.col(label_b).alias("otra")), unit, "left")
    is_pair = F.lit(False)
    for x, y in pairs:
        is_pair = is_pair | ((F.col("clase") == x) & (F.col("otra") == y))
    return joined.select(unit, "clase", F.coalesce(is_pair, F.lit(False)).alias("estable"))


def adjusted_rand(table: DataFrame) -> DataFrame:
    """Adjusted Rand index from the overlap table, in one row; 1 where both partitions have one class."""
    two = lambda c: c * (c - 1) / 2
    cells = table.agg(F.sum(two(F.col("n"))).alias("s"), F.sum("n").alias("n"))
    a = table.groupBy("clase_1").agg(F.sum("n").alias("x")).agg(F.sum(two(F.col("x")))).scalar()
    b = table.groupBy("clase_2").agg(F.sum("n").alias("x")).agg(F.sum(two(F.col("x")))).scalar()
    whole = cells.withColumn("a", a).withColumn("b", b)
    expected = F.col("a") * F.col("b") / two(F.col("n"))
    most = (F.col("a") + F.col("b")) / 2
    return whole.select("n", F.when(most == expected, 1.0).otherwise((F.col("s") - expected) / (most - expected)).alias("ari"))


def verdicts(methods: dict[str, DataFrame], unit: str, label: str, mode: str) -> DataFrame:
    """Per unit the class of the primary method and which methods find it stable.

    ``methods`` name to (unit, label, estable), the first is primary; ``mode`` is ``primary``, ``any`` or
    ``all``: what makes a unit stable. ``etiqueta`` joins the names of the methods that agree, or ``inestable``.
    """
    names = list(methods)
    out = methods[names[0]].select(unit, F.col(label).alias("clase"), F.col("estable").alias(f"_{names[0]}"))
    for name in names[1:]:
        out = out.join(methods[name].select(unit, F.col("estable").alias(f"_{name}")), unit, "left")
    flags = [F.coalesce(f"_{n}", F.lit(False)) for n in names]
    stable = flags[0]
    for f in flags[1:]:
        stable = stable | f if mode == "any" else stable & f if mode == "all" else stable
    tag = F.concat_ws("_", *(F.when(f, n) for f, n in zip(flags, names)))
    return out.select(unit, "clase", stable.alias("estable"), F.when(tag == "", "inestable").otherwise(tag).alias("etiqueta"))


def density_labels(points: np.ndarray, least: int = 5) -> np.ndarray:
    """Density clusters of few points: mutual-reachability spanning tree, cut at its largest gaps; noise is -1.

    A stand-in for hierarchical density clustering where that library is absent.
    """
    n = len(points)
    if n < 2 * least:
        return np.full(n, -1)
    d = np.sqrt(((points[:, None] - points[None]) ** 2).sum(axis=2))
    core = np.sort(d, axis=1)[:, min(least, n - 1)]
    reach = np.maximum(d, np.maximum(core[:, None], core[None]))
    best, parent, inside = reach[0].copy(), np.zeros(n, dtype=int), np.zeros(n, dtype=bool)
    inside[0], edges = True, []
    for _ in range(n - 1):
        j = int(np.where(inside, np.inf, best).argmin())
        edges.append((best[j], parent[j], j))
        inside[j] = True
        closer = reach[j] < best
        best, parent = np.where(closer, reach[j], best), np.where(closer, j, parent)
    heights = np.sort([e[0] for e in edges])
    gap = int(np.diff(heights).argmax()) if len(heights) > 1 else 0
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for h, i, j in sorted(edges):
        if h <= heights[gap]:
            root[find(i)] = find(j)
    roots = [find(i) for i in range(n)]
    sizes = pd.Series(roots).value_counts()
    names = {r: k for k, r in enumerate(sorted(r for r, c in sizes.items() if c >= least))}
    return np.array([names.get(r, -1) for r in roots])
