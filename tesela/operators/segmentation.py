"""Cutting documents into elementary units and context units."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesela.functions.vectors import cosine
from tesela.operators.network import ward_from

# Weight of a cut after each mark, and after any other token.
CUT_WEIGHTS = {"?": 6.0, "!": 6.0, ".": 6.0, "…": 6.0, ":": 5.0, ";": 4.0, ",": 1.0}
OTHER_WEIGHT = 0.01
IDEAL_TOKENS, WINDOW_SHARE = 40, 0.4


def cut_places(weights: np.ndarray, ideal: int = IDEAL_TOKENS, share: float = WINDOW_SHARE) -> list[tuple[int, int]]:
    """Token ranges [from, to): while more than ideal + window tokens remain, cut after the first place in the
    window around the ideal length that has the greatest weight / (distance + 1)."""
    window = int(share * ideal)
    places = np.arange(ideal - window, ideal + window)
    falloff = 1.0 / (np.abs(places - ideal) + 1)
    out, at, n = [], 0, len(weights)
    while n - at > ideal + window:
        score = weights[at + places] * falloff
        end = at + int(places[int(score.argmax())]) + 1
        out.append((at, end))
        at = end
    if at < n:
        out.append((at, n))
    return out


def elementary_units(texts: DataFrame, key: str, text: str, ideal: int = IDEAL_TOKENS, min_words: int = 3) -> DataFrame:
    """key, local_idx, start_char, end_char, n_tokens, texto of the units of each text.

    Units of fewer than ``min_words`` words are dropped and take no number. A null or blank text has none.
    """
    import re

    token = re.compile(r"[^\W_]+(?:['’\-][^\W_]+)*|[^\w\s]|_")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                rows, index, starts, ends, sizes, pieces = [], [], [], [], [], []
                for row, value in enumerate(part.column("_t").to_pylist()):
                    found = [m.span() for m in token.finditer(value or "")]
                    weights = np.array([CUT_WEIGHTS.get(value[s:e], OTHER_WEIGHT) for s, e in found])
                    i = 0
                    for a, b in cut_places(weights, ideal):
                        s, e = found[a][0], found[b - 1][1]
                        if len(value[s:e].split()) < min_words:
                            continue
                        for x, y in zip((rows, index, starts, ends, sizes, pieces), (row, i, s, e, b - a, value[s:e])):
                            x.append(y)
                        i += 1
                keys = part.column(key).take(pa.array(rows, pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [keys, *(pa.array(x, pa.int32()) for x in (index, starts, ends, sizes)), pa.array(pieces, pa.string())],
                    [key, "local_idx", "start_char", "end_char", "n_tokens", "texto"],
                )

    kind = dict(texts.dtypes)[key]
    return texts.select(key, F.col(text).alias("_t")).mapInArrow(run, f"`{key}` {kind}, local_idx int, start_char int, end_char int, n_tokens int, texto string")


#: Units of a document that one task takes; a longer document is parted into blocks of so many.
BLOCK = 100_000


def _has_large(units: DataFrame, doc: str, block: int) -> bool:
    return bool(units.groupBy(doc).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block).limit(1).count())


def document_windows(units: DataFrame, doc: str, order: str, reach: int = 1, block: int = BLOCK) -> tuple[DataFrame, object]:
    """(rows, window) for leads and lags of up to ``reach`` units of a document.

    If a document has more than ``block`` units, its units are numbered by a range sort and parted into blocks; each
    block also gets ``reach`` rows of its neighbours, with _propia false. So no task holds such a document. After
    the window has been used the rows go through :func:`own_rows`.
    """
    if not _has_large(units, doc, block):
        return units.withColumn("_propia", F.lit(True)), Window.partitionBy(doc).orderBy(order)
    from tesela.operators.lexical import with_rank

    ranked = with_rank(units, [F.col(order)], "_lugar", start=0, by=doc)
    place, own = F.pmod(F.col("_lugar"), F.lit(block)), F.floor(F.col("_lugar") / block)
    near = F.array(own, F.when((place < reach) & (own > 0), own - 1), F.when(place >= block - reach, own + 1))
    parted = ranked.withColumn("_propio", own).withColumn("_bloque", F.explode(F.filter(near, lambda x: x.isNotNull())))
    return parted.withColumn("_propia", F.col("_bloque") == F.col("_propio")), Window.partitionBy(doc, "_bloque").orderBy("_lugar")


def own_rows(rows: DataFrame) -> DataFrame:
    return rows.where("_propia").drop("_propia", "_propio", "_bloque", "_lugar")


def running_sum(units: DataFrame, doc: str, order: str, value: Column, name: str, block: int = BLOCK) -> DataFrame:
    """Adds the sum of ``value`` over the units of a document before each, null for the first.

    A document of more than ``block`` units is summed by blocks, and the sums of the blocks are added.
    """
    if not _has_large(units, doc, block):
        return units.withColumn(name, F.sum(value).over(Window.partitionBy(doc).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)))
    from tesela.operators.lexical import with_rank

    ranked = with_rank(units.withColumn("_v", value), [F.col(order)], "_lugar", start=0, by=doc).withColumn("_b", F.floor(F.col("_lugar") / block))
    inner = F.sum("_v").over(Window.partitionBy(doc, "_b").orderBy("_lugar").rowsBetween(Window.unboundedPreceding, -1))
    blocks = ranked.groupBy(doc, "_b").agg(F.sum("_v").alias("_t"))
    before = F.sum("_t").over(Window.partitionBy(doc).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))  # a row per block
    joined = ranked.withColumn("_i", inner).join(blocks.select(doc, "_b", before.alias("_s")), [doc, "_b"])
    total = F.when(F.col("_i").isNull() & F.col("_s").isNull(), None).otherwise(F.coalesce("_i", F.lit(0)) + F.coalesce("_s", F.lit(0)))
    return joined.withColumn(name, total).drop("_v", "_lugar", "_b", "_i", "_s")


def blocked_fold(values: DataFrame, doc: str, order: str, n_states: int, advance, block: int = BLOCK) -> DataFrame:
    """(doc, order, grupo, cierra): a fold over the values _s (int) of each document in order.

    ``advance(states, value)`` takes an array of states from 0 to ``n_states`` - 1 and gives the next ones and whether
    each closes a group; a document begins in state 0 and group 0. What a block of ``block`` units does to each state
    is found side by side; the blocks of a document are then folded (one row each), and each block is run once from
    the state it really begins with. So no task holds a document, whatever share of the units it has.
    """
    window = Window.partitionBy(doc).orderBy(order)
    large = _has_large(values, doc, block)
    if large:
        from tesela.operators.lexical import with_rank

        placed = with_rank(values, [F.col(order)], "_i", start=0, by=doc)
        parts = placed.withColumn("_b", F.floor(F.col("_i") / block).cast("int"))
    else:
        parts = values.withColumn("_i", F.row_number().over(window) - 1).withColumn("_b", F.lit(0))
    kinds = dict(values.dtypes)
    lists = parts.groupBy(doc, "_b").agg(F.sort_array(F.collect_list(F.struct("_i", F.col(order).alias("o"), F.col("_s").alias("s")))).alias("us"))

    def moves(starts: pd.Series) -> pd.DataFrame:
        out = []
        for us in starts:
            state, closed = np.arange(n_states), np.zeros(n_states, dtype=np.int64)
            for s in us:
                state, full = advance(state, int(s))
                closed += full
            out.append({"estado": state.tolist(), "cerradas": closed.tolist()})
        return pd.DataFrame(out)

    if large:
        move = F.pandas_udf(moves, "struct<estado:array<long>,cerradas:array<long>>")
        done = lists.select(doc, "_b", move(F.transform("us", lambda u: u.s)).alias("m"))
        chain = done.groupBy(doc).agg(F.sort_array(F.collect_list(F.struct("_b", "m"))).alias("bs"))
        begin = F.struct(F.lit(0).cast("long").alias("estado"), F.lit(0).cast("long").alias("g"), F.array().cast("array<struct<_b:int,estado:long,g:long>>").alias("r"))

        def link(state: Column, x: Column) -> Column:
            row = F.struct(x["_b"].alias("_b"), state.estado.alias("estado"), state.g.alias("g"))
            at = (state.estado + 1).cast("int")
            return F.struct(F.element_at(x["m"]["estado"], at).alias("estado"), (state.g + F.element_at(x["m"]["cerradas"], at)).alias("g"), F.concat(state.r, F.array(row)).alias("r"))

        starts = chain.select(doc, F.explode(F.aggregate("bs", begin, link).r).alias("x")).select(doc, "x._b", F.col("x.estado").cast("int").alias("_estado"), F.col("x.g").cast("int").alias("_g"))
        lists = lists.join(starts, [doc, "_b"])
    else:
        lists = lists.withColumn("_estado", F.lit(0)).withColumn("_g", F.lit(0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                us = batch.column("us")[row].values
                sizes = us.field("s").to_pylist()
                state, g = np.array([batch.column("_estado")[row].as_py()]), batch.column("_g")[row].as_py()
                index, closes = np.empty(len(sizes), dtype=np.int32), np.empty(len(sizes), dtype=bool)
                for i, s in enumerate(sizes):
                    index[i] = g
                    state, full = advance(state, s)
                    closes[i] = full[0]
                    g += int(full[0])
                keys = batch.column(doc).take(pa.array(np.full(len(sizes), row)))
                yield pa.RecordBatch.from_arrays([keys, us.field("o"), pa.array(index), pa.array(closes)], [doc, order, "grupo", "cierra"])

    return lists.select(doc, "us", "_estado", "_g").mapInArrow(run, f"`{doc}` {kinds[doc]}, `{order}` {kinds[order]}, grupo int, cierra boolean")


def context_units(units: DataFrame, doc: str, order: str, size: str, min_forms: int = 10, block: int = BLOCK) -> DataFrame:
    """Adds uc_idx: a unit closes its context unit once ``size`` adds up to ``min_forms``; the rest is one too.

    The running sum starts anew at each close: a fold by blocks (:func:`blocked_fold`) over the ``min_forms`` sums
    that a unit can meet. A null size is 0.
    """

    def advance(total: np.ndarray, size_: int) -> tuple[np.ndarray, np.ndarray]:
        total = total + size_
        full = total >= min_forms
        return np.where(full, 0, total), full

    sizes = units.select(doc, order, F.greatest(F.coalesce(F.col(size), F.lit(0)).cast("int"), F.lit(0)).alias("_s"))
    placed = blocked_fold(sizes, doc, order, min_forms, advance, block)
    return units.join(placed.select(doc, order, F.col("grupo").alias("uc_idx")), [doc, order])


def assembled(units: DataFrame, doc: str, order: str, text: str | None = None, *arrays: str) -> DataFrame:
    """One row per context unit: its units in order and their arrays one after another."""
    fields = [order, "uce_id", *([text] if text else []), *arrays]
    got = units.groupBy(doc, "uc_idx").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("u"))
    out = [F.concat_ws("_", F.lit("uc"), doc, "uc_idx").alias("uc_id"), doc, "uc_idx", F.col("u.uce_id").alias("uce_ids")]
    if text:
        out.append(F.array_join(f"u.{text}", " ").alias(text))
    return got.select(*out, *(F.flatten(f"u.{a}").alias(a) for a in arrays))


def section_of(units: DataFrame, sections: DataFrame, doc: str, start: str) -> DataFrame:
    """Adds the section whose [s_start, s_end) holds the unit's start, the first by place if several do."""
    joined = units.join(sections, doc, "left").where(F.col("s_start").isNull() | ((F.col(start) >= F.col("s_start")) & (F.col(start) < F.col("s_end"))))
    return joined.groupBy(*units.columns).agg(F.min_by("seccion", "s_start").alias("seccion"))


def section_numbers(segments: DataFrame, doc: str, order: str, section: str = "seccion") -> DataFrame:
    """Adds section_id: sections numbered from 0 in the order they first come in a document; null is Sin_Seccion."""
    named = segments.withColumn(section, F.coalesce(section, F.lit("Sin_Seccion")))
    first = named.groupBy(doc, section).agg(F.min(order).alias("_f"))
    numbered = first.withColumn("section_id", F.row_number().over(Window.partitionBy(doc).orderBy("_f", section)) - 1).drop("_f")
    return named.join(numbered, [doc, section])


def interval_starts(segments: DataFrame, doc: str, order: str, text: str, gap: int = 2, block: int = BLOCK) -> DataFrame:
    """s_start and s_end of the segments of a document laid one after another, ``gap`` characters apart."""
    length = F.coalesce(F.length(text), F.lit(0))
    start = F.coalesce("s_start", F.lit(0))
    return running_sum(segments, doc, order, length + gap, "s_start", block).withColumn("s_start", start).withColumn("s_end", F.col("s_start") + length)


def cohesion(units: DataFrame, doc: str, order: str, vector: str, chains: str | None = None, w_coref: float = 0.0, block: int = BLOCK) -> DataFrame:
    """Adds cohesion with the unit before: likeness (cosine from 0 to 1) and, by ``w_coref``, Jaccard of chains; null for the first."""
    rows, window = document_windows(units, doc, order, 1, block)
    likeness = (cosine(F.lag(vector).over(window), F.col(vector)) + 1) / 2
    similar = F.when(likeness.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), likeness)))
    if chains is None:
        return own_rows(rows.withColumn("cohesion", similar))
    last, now = F.coalesce(F.lag(chains).over(window), F.array()), F.coalesce(F.col(chains), F.array())
    union = F.size(F.array_union(last, now))
    jaccard = F.when(union > 0, F.size(F.array_intersect(last, now)) / union).otherwise(0.0)
    return own_rows(rows.withColumn("cohesion", (1 - w_coref) * similar + w_coref * jaccard))


def topic_shift(units: DataFrame, doc: str, order: str, vector: str, block: int = BLOCK) -> DataFrame:
    """Adds topic_shift = 1 - cosine with the unit before; 1 for the first and where a vector is missing."""
    rows, window = document_windows(units, doc, order, 1, block)
    return own_rows(rows.withColumn("topic_shift", F.coalesce(1 - cosine(F.lag(vector).over(window), F.col(vector)), F.lit(1.0))))


def smoothed(units: DataFrame, doc: str, order: str, score: str, width: int = 3, block: int = BLOCK) -> DataFrame:
    """Adds suave: centred moving mean; at the ends the edge value stands for what is missing."""
    half = width // 2
    rows, window = document_windows(units, doc, order, max(1, half), block)
    total = F.col(score)
    for k in range(1, half + 1):
        # the farthest value there is within reach: beyond an end that is the edge value
        for side in (F.lag, F.lead):
            total = total + F.coalesce(*(side(score, j).over(window) for j in range(k, 0, -1)), F.col(score))
    return own_rows(rows.withColumn("suave", total / (2 * half + 1)))


def boundaries(units: DataFrame, doc: str, order: str, score: str, section: str, threshold: float = 0.5, min_drop: float = 0.05, min_gap: int = 2, block: int = BLOCK) -> DataFrame:
    """Adds frontera (the unit ends a segment) and segmento.

    A change of section cuts if ``min_gap`` units have passed and is never tested by score; else a local
    minimum at least ``min_drop`` under the threshold does. The last unit always ends one. Flags come from
    leads and lags; the gap hangs on the cut before and is a fold by blocks over the document's flags.
    """
    rows, window = document_windows(units, doc, order, 1, block)
    before, after = F.lag(score).over(window), F.lead(score).over(window)
    hard = F.lead(section).over(window).isNotNull() & ~F.lead(section).over(window).eqNullSafe(F.col(section))
    soft = (threshold - F.col(score) >= min_drop) & (F.coalesce(before, F.col(score)) >= F.col(score)) & (F.coalesce(after, F.col(score)) >= F.col(score))
    may = F.when(F.lead(order).over(window).isNull(), 2).when(hard | soft, 1).otherwise(0)
    flags = own_rows(rows.withColumn("_s", may.cast("int"))).select(doc, order, "_s")

    def advance(gap: np.ndarray, flag: int) -> tuple[np.ndarray, np.ndarray]:
        gap = np.minimum(gap + 1, min_gap)
        cut = np.full(len(gap), flag == 2) | ((flag == 1) & (gap >= min_gap))
        return np.where(cut, 0, gap), cut

    placed = blocked_fold(flags, doc, order, min_gap + 1, advance, block)
    return units.join(placed.select(doc, order, F.col("cierra").alias("frontera"), F.col("grupo").alias("segmento")), [doc, order])


def segment_ranges(marked: DataFrame, doc: str, order: str) -> DataFrame:
    """First and last unit of each segment."""
    return marked.groupBy(doc, "segmento").agg(F.min(order).alias("desde"), F.max(order).alias("hasta"), F.count(F.lit(1)).alias("n"))


def merge_small(sizes: np.ndarray, vectors: np.ndarray, least: int) -> list[list[int]]:
    """Segments under ``least`` join the neighbour for which the merged vector is nearest to both; then the search starts anew."""
    groups = [[i] for i in range(len(sizes))]
    cos = lambda a, b: float(a @ b / max(np.linalg.norm(a) * np.linalg.norm(b), 1e-12))
    while len(groups) > 1:
        size = [sizes[g].sum() for g in groups]
        small = next((i for i, s in enumerate(size) if s < least), None)
        if small is None:
            break
        mean = [np.average(vectors[g], axis=0, weights=np.maximum(sizes[g], 1e-9)) for g in groups]
        options = []
        for j in (small - 1, small + 1):
            if 0 <= j < len(groups):
                both = (mean[small] * size[small] + mean[j] * size[j]) / max(size[small] + size[j], 1e-9)
                options.append((cos(both, mean[small]) + cos(both, mean[j]), -j, j))
        j = max(options)[2]
        a, b = sorted((small, j))
        groups[a : b + 1] = [groups[a] + groups[b]]
    return groups


def merge_smaller_neighbour(sizes: list[int], least: int) -> list[list[int]]:
    """Groups under ``least`` join the smaller neighbour, the left one on ties; then the search starts anew."""
    groups = [[i] for i in range(len(sizes))]
    while len(groups) > 1:
        size = [sum(sizes[i] for i in g) for g in groups]
        small = next((i for i, s in enumerate(size) if s < least), None)
        if small is None:
            break
        near = [j for j in (small - 1, small + 1) if 0 <= j < len(groups)]
        j = min(near, key=lambda k: (size[k], k))
        a, b = sorted((small, j))
        groups[a : b + 1] = [groups[a] + groups[b]]
    return groups


def recursive_groups(vectors: np.ndarray, depth: int = 0, band: int = 200, window: int = 10, many: int = 500) -> list[list[int]]:
    """Segments of a document by Ward's tree of its sentence vectors, cut at the 60th percentile of its heights.

    Beyond ``band`` sentences only those within ``window`` are compared; beyond ``many`` the linear method serves.
    """
    n = len(vectors)
    if n <= 1 or depth > 3:
        return [list(range(n))] if n else []
    if n > many:
        return linear_groups(vectors)
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    unit = vectors / np.maximum(norm, 1e-12)
    d = 1 - np.clip(unit @ unit.T, 0, 1)
    if n > band:
        far = np.abs(np.subtract.outer(np.arange(n), np.arange(n))) > window
        d[far] = 1.0
    tree = ward_from(d * d)
    limit = np.percentile(tree[:, 2], 60)
    label = list(range(n))
    of = {i: [i] for i in range(n)}
    for k, (a, b, h, _) in enumerate(tree):
        if int(a) in of and int(b) in of and h <= limit:
            of[n + k] = of.pop(int(a)) + of.pop(int(b))
    for g, members in of.items():
        for i in members:
            label[i] = g
    parts, start = [], 0
    for i in range(1, n + 1):
        if i == n or label[i] != label[i - 1]:
            parts.append(list(range(start, i)))
            start = i
    if len(parts) == 1:
        return parts
    return [[p[i] for i in g] for p in parts for g in recursive_groups(vectors[p], depth + 1, band, window, many)]


def linear_groups(vectors: np.ndarray, window: int = 20, least: float = 0.6) -> list[list[int]]:
    """A sentence joins the open segment if its cosine with the mean of the last ``window`` of it is ``least`` or more."""
    out: list[list[int]] = []
    for i, v in enumerate(vectors):
        if out:
            mean = vectors[out[-1][-window:]].mean(axis=0)
            if mean @ v / max(np.linalg.norm(mean) * np.linalg.norm(v), 1e-12) >= least:
                out[-1].append(i)
                continue
        out.append([i])
    return out


def grouped(units: DataFrame, doc: str, order: str, vector: str, kernel=recursive_groups) -> DataFrame:
    """doc, order, grupo: a kernel over the vectors of each document in order; documents run side by side."""
    kinds = dict(units.dtypes)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(order, kind="stable")
        groups = kernel(np.stack(part[vector].map(np.asarray).to_list()).astype(float))
        label = np.zeros(len(part), dtype=np.int32)
        for g, members in enumerate(groups):
            label[members] = g
        return pd.DataFrame({doc: part[doc].to_numpy(), order: part[order].to_numpy(), "grupo": label})

    return units.select(doc, order, vector).groupBy(doc).applyInPandas(run, f"`{doc}` {kinds[doc]}, `{order}` {kinds[order]}, grupo int")


def entity_boundary(units: DataFrame, doc: str, order: str, vector: str, entities: str, content: str, block: int = BLOCK) -> DataFrame:
    """Adds puntaje of the boundary before a unit: half unlikeness, half unshared entities; -1 under four content words."""
    rows, window = document_windows(units, doc, order, 1, block)
    last, now = F.coalesce(F.lag(entities).over(window), F.array()), F.coalesce(F.col(entities), F.array())
    union = F.size(F.array_union(last, now))
    jaccard = F.when(union > 0, F.size(F.array_intersect(last, now)) / union).otherwise(0.0)
    score = 0.5 * (1 - cosine(F.lag(vector).over(window), F.col(vector))) + 0.5 * (1 - jaccard)
    return own_rows(rows.withColumn("puntaje", F.when(F.col(content) < 4, -1.0).otherwise(score)))


def merge_lowest(scores: list[float], most: int) -> list[list[int]]:
    """Units split at every boundary but the weakest, which go first until ``most`` segments are left.

    ``scores`` has one value per boundary between neighbours.
    """
    groups = [[i] for i in range(len(scores) + 1)]
    edge = list(scores)
    while len(groups) > most and edge:
        k = int(np.argmin(edge))
        groups[k : k + 2] = [groups[k] + groups[k + 1]]
        del edge[k]
    return groups


def bridge_merge(bridged: list[bool]) -> list[list[int]]:
    """Left fold: a segment joins the open group if a chain bridges it to the segment before."""
    out: list[list[int]] = []
    for i in range(len(bridged) + 1):
        if out and bridged[i - 1]:
            out[-1].append(i)
        else:
            out.append([i])
    return out


def relocked(units: DataFrame, texts: DataFrame, doc: str, order: str, unit_text: str, text: str) -> DataFrame:
    """Adds inicio: where each unit stands in its document, searched from the unit before on; -1 if not found.

    The cursor is a fold over the document's units in the JVM.
    """
    lists = units.groupBy(doc).agg(F.sort_array(F.collect_list(F.struct(order, unit_text))).alias("l")).join(texts.select(doc, text), doc)
    start = F.struct(F.lit(1).alias("c"), F.array().cast(f"array<struct<o:{dict(units.dtypes)[order]},inicio:int>>").alias("r"))

    def step(state: Column, x: Column) -> Column:
        at = F.call_function("locate", x[unit_text], F.col(text), state.c)
        row = F.struct(x[order].alias("o"), (at - 1).alias("inicio"))
        return F.struct(F.when(at > 0, at + F.length(x[unit_text])).otherwise(state.c).alias("c"), F.concat(state.r, F.array(row)).alias("r"))

    return lists.select(doc, F.explode(F.aggregate("l", start, step).r).alias("x")).select(doc, F.col("x.o").alias(order), "x.inicio")


def sliding_windows(units: DataFrame, doc: str, order: str, text: str, width: int = 3, most: int = 4000, block: int = BLOCK) -> DataFrame:
    """Adds ventana: the last ``width`` units' texts, shortened from the left to ``most`` characters at whole units."""
    rows, window = document_windows(units, doc, order, max(1, width - 1), block)
    window = window.rowsBetween(-(width - 1), 0)
    joined = F.array_join(F.col("_w"), " ")
    out = rows.withColumn("_w", F.collect_list(text).over(window))
    shrunk = joined
    for k in range(1, width):
        shorter = F.array_join(F.slice("_w", F.greatest(F.lit(1), F.lit(k + 1)), F.greatest(F.lit(1), F.size("_w") - k)), " ")
        shrunk = F.when(F.length(shrunk) > most, shorter).otherwise(shrunk)
    return own_rows(out.withColumn("ventana", shrunk).drop("_w"))


def shifts(units: DataFrame, doc: str, order: str, vector: str, profile: str, substance: str, least: float = 0.6, far: float = 0.4, block: int = BLOCK) -> DataFrame:
    """Adds cambio_de_tema: both neighbours have substance and their cosine is under ``least`` or their label profiles over ``far`` apart."""
    from tesela.operators.grammar import profile_distance

    rows, window = document_windows(units, doc, order, 1, block)
    apart = (cosine(F.lag(vector).over(window), F.col(vector)) < least) | (profile_distance(F.lag(profile).over(window), F.col(profile)) > far)
    return own_rows(rows.withColumn("cambio_de_tema", F.coalesce(apart & F.col(substance) & F.lag(substance).over(window), F.lit(False))))


def progressive(marked: DataFrame, doc: str, order: str, block: int = BLOCK) -> DataFrame:
    """Adds segmento: a new one starts at each change of topic; a running sum, as the test is between neighbours."""
    turn = F.col("cambio_de_tema").cast("int")
    return running_sum(marked, doc, order, turn, "segmento", block).withColumn("segmento", (F.coalesce("segmento", F.lit(0)) + turn).cast("int"))


def overflow_pieces(n_tokens: int, most: int, scores: list[float]) -> list[list[int]]:
    """Sentences of a segment over its token budget, in n // most + 1 pieces cut at the strongest boundaries."""
    return merge_lowest(scores, n_tokens // most + 1) if n_tokens > most else [list(range(len(scores) + 1))]


def term_stream(units: DataFrame, unit: str, *arrays: str) -> DataFrame:
    """unit, termino: stems, bigrams and trigrams of a unit in one stream."""
    joined = F.concat(*(F.coalesce(F.col(a), F.array().cast("array<string>")) for a in arrays))
    return units.select(unit, F.explode(joined).alias("termino")).where("termino is not null and termino <> ''")


def global_offsets(spans: DataFrame, start_of_unit: str, *columns: str) -> DataFrame:
    """Places in a unit as places in its document."""
    return spans.withColumns({c: F.col(c) + F.col(start_of_unit) for c in columns})
