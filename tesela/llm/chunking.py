"""Problem 1: cutting oversized texts at natural boundaries, with overlap."""

from __future__ import annotations

import re
from bisect import bisect_left

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesela.llm.common import WHITE_SPACE

WORD = f"[^{WHITE_SPACE}]+"
_WORD = re.compile(WORD)
_LINE = re.compile("[\n\r\x0b\x0c\x85\u2028\u2029]")
_CLOSERS = "\"'»”’)]}」』"
#: Strength of the boundary after a word that ends so; a paragraph has 6 and a line end 5.
_MARKS = {m: s for s, marks in ((4, ".!?…。！？؟।"), (3, ";:；：؛·"), (2, ",、，،—–")) for m in marks}
_OPENERS_AFTER = "—–-¿¡«“"
PIECE = "array<struct<pieza:int,inicio:int,fin:int,palabras:int,limite_natural:boolean,trozo:string>>"


def count_words(text: Column) -> Column:
    """Runs of characters other than Unicode white space. Null counts as null."""
    return F.regexp_count(text, F.lit(WORD))


def boundary_strengths(text: str, spans: list[tuple[int, int]]) -> np.ndarray:
    """Strength of the natural boundary after each word; 0 where there is none."""
    out = np.zeros(len(spans), dtype=np.int8)
    for i, (start, end) in enumerate(spans[:-1]):
        gap = text[end : spans[i + 1][0]]
        if gap != " ":
            lines = len(_LINE.findall(gap.replace("\r\n", "\n")))
            if lines:
                out[i] = 6 if lines > 1 else 5
                continue
        word = text[start:end].rstrip(_CLOSERS)
        if word:
            strength = _MARKS.get(word[-1], 0)
            if strength == 4 and word[-1] == "." and len(word) <= 4 and not text[spans[i + 1][0]].isupper():
                strength = 0  # an abbreviation, or an initial
            out[i] = strength
    return out


def plan_pieces(strengths: np.ndarray, limit: int, overlap: int) -> list[tuple[int, int]]:
    """Word ranges [from, to) of the pieces.

    The least number of pieces gives equally long targets; each is snapped to the strongest boundary
    near it, then anywhere within reach. If no boundary lets the remaining pieces hold the limit though
    there is one in the piece, a piece is added and the rest is balanced anew.
    """
    n = len(strengths)
    limit = max(1, limit)
    overlap = min(max(0, overlap), limit - 1)
    if n <= limit:
        return [(0, n)]
    step = limit - overlap
    natural = np.flatnonzero(strengths > 0) + 1  # ends of pieces
    pieces, start = [], 0
    left = -(-(n - overlap) // step)
    while True:
        if n - start <= limit:
            pieces.append((start, n))
            return pieces
        left = max(left, -(-(n - start - overlap) // step), 2)
        least, most = start + overlap + 1, start + limit
        while True:
            low = max(least, n - (left - 1) * step)
            target = start + overlap + (n - start - overlap) / left
            inside = natural[bisect_left(natural, low) : bisect_left(natural, most + 1)]
            if len(inside) or low == least:
                break
            if not bisect_left(natural, most + 1) - bisect_left(natural, least):
                break  # no boundary in the whole piece
            left += 1
        if len(inside):
            near = inside[np.abs(inside - target) <= max(4, 0.2 * (target - start))]
            pool = near if len(near) else inside
            best = min(pool, key=lambda e: (-int(strengths[e - 1]), abs(e - target)))
            end = int(best)
        else:
            end = int(min(max(round(target), low), most))
        pieces.append((start, end))
        start, left = end - overlap, left - 1


def pieces_of(text: str | None, limit: int, overlap: int, with_text: bool = False) -> list[dict] | None:
    """The pieces of one text as character ranges, and themselves if asked for; None for a null text or one without words."""
    if text is None:
        return None
    spans = [m.span() for m in _WORD.finditer(text)]
    if not spans:
        return None
    strengths = boundary_strengths(text, spans)
    plan = plan_pieces(strengths, limit, overlap)
    return [
        {"pieza": i, "inicio": spans[a][0], "fin": spans[b - 1][1], "palabras": b - a, "limite_natural": bool(b == len(spans) or strengths[b - 1] > 0),
         "trozo": text[spans[a][0] : spans[b - 1][1]] if with_text else None}
        for i, (a, b) in enumerate(plan)
    ]


def _pieces(text: pd.Series, limit: pd.Series, overlap: pd.Series) -> pd.Series:
    return pd.Series([pieces_of(t, n, o, True) for t, n, o in zip(text, limit, overlap)], dtype=object)


def _ranges(text: pd.Series, limit: pd.Series, overlap: pd.Series) -> pd.Series:
    return pd.Series([pieces_of(t, n, o) for t, n, o in zip(text, limit, overlap)], dtype=object)


def split_oversized(texts: DataFrame, config: DataFrame, only_oversized: bool = False, with_text: bool = True) -> DataFrame:
    """Pieces of (tabla, clave, texto, config_id) under the word limit of its configuration.

    Columns: tabla, clave, pieza (from 0), inicio and fin (code points), palabras, limite_natural
    (whether it ends at a natural boundary), trozo (null unless ``with_text``). Neighbours share exactly solape_tokens words. A text
    within its limit is one piece; a null text or one without words has none. A null or unknown
    config_id means configuration 1, without which nothing is cut; further columns, whatever their names, are
    left behind. Words are counted in the JVM; only oversized texts go to Python.
    """
    limits = config.select(
        "config_id", F.col("max_tokens_por_uce").alias("limite"), F.col("solape_tokens").alias("solape")
    ).dropDuplicates(["config_id"])
    first = limits.where("config_id = 1").select(F.col("limite").alias("limite_1"), F.col("solape").alias("solape_1"))
    usual = first.first()
    known = texts.select("tabla", "clave", "texto", "config_id").join(limits, "config_id", "left").withColumns(
        {
            "limite": F.coalesce("limite", F.lit(usual["limite_1"] if usual else None).cast("int")),
            "solape": F.coalesce("solape", F.lit(usual["solape_1"] if usual else None).cast("int"), F.lit(0)),
        }
    )
    # so many words take at least twice as many characters less one: shorter texts need no count here
    may_be = F.char_length("texto") >= 2 * (F.col("limite") + 1) - 1
    if only_oversized:
        known = known.where(may_be)
    known = known.withColumn("n", count_words(F.col("texto")))
    too_long = F.col("n") > F.col("limite")
    if only_oversized:
        known = known.where(too_long)
    else:
        known = known.where("n > 0")
    cut = known.withColumn("piezas", F.pandas_udf(_pieces if with_text else _ranges, PIECE)(F.when(too_long, F.col("texto")), "limite", "solape"))
    whole = F.array(
        F.struct(
            F.lit(0).alias("pieza"), F.lit(0).alias("inicio"), F.char_length("texto").alias("fin"),
            F.col("n").cast("int").alias("palabras"), F.lit(True).alias("limite_natural"),
            (F.col("texto") if with_text else F.lit(None).cast("string")).alias("trozo"),
        )
    )
    return cut.select("tabla", "clave", F.explode(F.coalesce("piezas", whole)).alias("p")).select("tabla", "clave", "p.*")
