"""Text normalisation, tokens and word forms."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words left out of an entity's representative, without and with contractions.
REPRESENTATIVE_STOP = "el la los las un una unos unas y de a".split()
REPRESENTATIVE_STOP_LONG = [*REPRESENTATIVE_STOP, "del", "al"]
#: Clitics a Spanish infinitive or gerund may end in, in the order they are tried.
CLITICS = "los las les nos me te se lo la le os".split()


def source_key(name: Column) -> Column:
    """A source's key: .txt.json, .json and .txt are cut out wherever they stand, in that order."""
    for ending in (".txt.json", ".json", ".txt"):
        name = F.replace(name, F.lit(ending), F.lit(""))
    return name


def compose(text: Column) -> Column:
    """Unicode NFC through an Arrow function."""
    def nfc(values: pd.Series) -> pd.Series:
        return values.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", t))

    return F.pandas_udf(nfc, "string")(text)


def normalize(text: Column, composed: bool = False) -> Column:
    """Byte order mark off, straight quotes, control characters (but tab and line ends) to spaces."""
    text = F.regexp_replace(text, "^\\x{feff}+", "")
    text = compose(text) if composed else text
    text = F.translate(text, "“”«»‘’", "\"\"\"\"''")
    return F.regexp_replace(text, "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]", " ")


def collapse(text: Column) -> Column:
    """For the segmenter: quotes to apostrophes, no zero-width characters, single blanks, trimmed."""
    text = F.translate(text, "“”«»’`\"", "'''''''")
    text = F.regexp_replace(text, "[\\x{200b}-\\x{200d}\\x{2060}\\x{feff}]", "")
    return F.btrim(F.regexp_replace(text, "\\s+", " "))


def clean_quote(quote: Column) -> Column:
    """A quote without marks around it and without dots of omission at its ends."""
    return F.regexp_replace(quote, "^[\\s\"'“”«»‘’]*(?:\\.\\.\\.|…)?[\\s\"'“”«»‘’]*|[\\s\"'“”«»‘’]*(?:\\.\\.\\.|…)?[\\s\"'“”«»‘’]*$", "")


def words(text: Column) -> Column:
    """Array of the runs of letters, in small letters."""
    return F.regexp_extract_all(F.lower(text), F.lit("(\\p{L}+)"), F.lit(1))


def tokens(text: Column) -> Column:
    """Array of words, numbers and single marks, as written."""
    return F.regexp_extract_all(text, F.lit("([\\p{L}\\p{M}]+(?:['’\\-][\\p{L}\\p{M}]+)*|\\p{N}+(?:[.,]\\p{N}+)*|[^\\s\\p{L}\\p{N}])"), F.lit(1))


def representative(name: Column, long: bool = False) -> Column:
    """An entity's representative without function words (``long``: contractions and short words too)."""
    stop = REPRESENTATIVE_STOP_LONG if long else REPRESENTATIVE_STOP
    keep = F.filter(F.split(F.btrim(F.lower(name)), "\\s+"), lambda w: ~w.isin(stop) & ((F.length(w) > 2) if long else F.lit(True)))
    return F.array_join(keep, " ")


def enclitic(form: Column) -> Column:
    """struct(base, clitico) of an infinitive or gerund with an enclitic, base of two letters at least; else null."""
    out = None
    for c in CLITICS:
        is_one = F.endswith(F.lower(form), F.lit(c)) & (F.length(form) >= len(c) + 2)
        one = F.struct(F.substring(form, F.lit(1), F.length(form) - len(c)).alias("base"), F.lit(c).alias("clitico"))
        out = F.when(is_one, one) if out is None else out.when(is_one, one)
    return out


def expand_contraction(lower: Column) -> Column:
    """al and del as their two words, any other word alone."""
    return F.when(lower == "al", F.array(F.lit("a"), F.lit("el"))).when(lower == "del", F.array(F.lit("de"), F.lit("el"))).otherwise(F.array(lower))


def tail_context(text: Column, width: int = 500) -> Column:
    """The last ``width`` characters; of more than 300 with a full stop, what follows the first one."""
    tail = F.right(text, F.lit(width))
    at = F.instr(tail, ".")
    return F.when((F.length(tail) > 300) & (at > 0), F.substring(tail, at + 1, F.lit(width))).otherwise(tail)
