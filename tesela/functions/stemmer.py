"""Spanish Snowball stemmer, after its published description, and its use on distinct words."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VOWELS = "aeiouáéíóúü"
# Fixed values of the published algorithm.
PRONOUNS = "selas selos sela selo las les los nos me se la le lo".split()
STEP_1 = (
    ("amientos imientos amiento imiento aciones uciones adoras adores ancias logías encias amente idades anzas ismos ables ibles istas adora acion ación antes ancia logía ución encia mente anza icos icas ismo able ible ista osos osas ador ante idad ivas ivos ico ica oso osa iva ivo").split()
)
STEP_2A = "yeron yendo yamos yais yan yen yas yes ya ye yo yó".split()
STEP_2B = (
    "aríamos eríamos iríamos iéramos iésemos aríais aremos eríais eremos iríais iremos ierais ieseis asteis isteis ábamos áramos ásemos arían"
    " arías aréis erían erías eréis irían irías iréis ieran iesen ieron iendo ieras ieses abais arais aseis éamos arán arás aría erán erás"
    " ería irán irás iría iera iese aste iste aban aran asen aron ando abas adas idas aras ases íais ados idos amos imos emos ará aré erá eré irá iré aba ada"
    " ida ara ase ían ado ido ías áis éis ía ad ed id an ió ar er ir as ís en es"
).split()
_PLAIN = str.maketrans("áéíóú", "aeiou")


def _regions(word: str) -> tuple[int, int, int]:
    """Where RV, R1 and R2 begin."""
    def after(start: int) -> int:
        m = re.compile(f"[{VOWELS}][^{VOWELS}]").search(word, start)
        return m.end() if m else len(word)

    r1 = after(0)
    r2 = after(r1)
    rv = len(word)
    if len(word) > 2:
        if word[1] not in VOWELS:
            m = re.compile(f"[{VOWELS}]").search(word, 2)
            rv = m.end() if m else len(word)
        elif word[0] in VOWELS:
            m = re.compile(f"[^{VOWELS}]").search(word, 2)
            rv = m.end() if m else len(word)
        else:
            rv = 3
    return rv, r1, r2


def stem(word: str) -> str:
    """The stem of a word in small letters, without acute accents at its vowels."""
    rv, _, r2 = _regions(word)

    def ends(endings: list[str], start: int) -> str:
        return max((e for e in endings if word.endswith(e) and len(word) - len(e) >= start), key=len, default="")

    pronoun = ends(PRONOUNS, rv)
    if pronoun:
        rest = word[: -len(pronoun)]
        for accented, plain in (("iéndo", "iendo"), ("ándo", "ando"), ("ár", "ar"), ("ér", "er"), ("ír", "ir")):
            if rest.endswith(accented) and len(rest) - len(accented) >= rv:
                word = rest[: -len(accented)] + plain
                break
        else:
            if any(rest.endswith(e) and len(rest) - len(e) >= rv for e in ("ando", "iendo", "ar", "er", "ir")) or rest.endswith("uyendo") and len(rest) - 5 >= rv:
                word = rest
    before = word
    ending = max((e for e in STEP_1 if word.endswith(e)), key=len, default="")
    at = len(word) - len(ending)
    if ending and at >= (_regions(word)[1] if ending == "amente" else r2):
        if ending == "amente":
            word = word[:at]
            for e, inner in (("ativ", True), ("iv", True), ("os", False), ("ic", False), ("ad", False)):
                if word.endswith(e) and len(word) - len(e) >= r2:
                    word = word[: -len(e)]
                    break
        elif ending == "mente":
            word = word[:at]
            for e in ("ante", "able", "ible"):
                if word.endswith(e) and len(word) - len(e) >= r2:
                    word = word[: -len(e)]
                    break
        elif ending.startswith("logía"):
            word = word[:at] + "log"
        elif ending in ("ución", "uciones"):
            word = word[:at] + "u"
        elif ending.startswith("encia"):
            word = word[:at] + "ente"
        else:
            word = word[:at]
            more = ("ic",) if ending in "adora ador acion ación adoras adores aciones ante antes ancia ancias".split() else ("abil", "ic", "iv") if ending.startswith("idad") else ("at",) if ending in "iva ivo ivas ivos".split() else ()
            for e in more:
                if word.endswith(e) and len(word) - len(e) >= r2:
                    word = word[: -len(e)]
                    break
    if word == before:
        e = ends(STEP_2A, rv)
        if e and word[: -len(e)].endswith("u"):
            word = word[: -len(e)]
        else:
            e = ends(STEP_2B, rv)
            if e:
                word = word[: -len(e)]
                if e in ("en", "es", "éis", "emos") and word.endswith("gu"):
                    word = word[:-1]
    for e in ("os", "a", "o", "á", "í", "ó", "e", "é"):
        if word.endswith(e) and len(word) - len(e) >= rv:
            word = word[: -len(e)]
            if e in ("e", "é") and word.endswith("gu") and len(word) - 1 >= rv:
                word = word[:-1]
            break
    return word.translate(_PLAIN)


def stemmed(word: Column) -> Column:
    """Stem of a column through an Arrow function; equal words of a batch are stemmed once."""
    def run(values: pd.Series) -> pd.Series:
        known = {w: stem(w.lower()) for w in values.dropna().unique()}
        return values.map(known)

    return F.pandas_udf(run, "string")(word)


def with_stems(terms: DataFrame, term: str = "termino", name: str = "raiz") -> DataFrame:
    """Adds the stem of each term, made once for every distinct term and joined back."""
    distinct = terms.select(term).distinct().withColumn(name, stemmed(F.col(term)))
    return terms.join(distinct, term)
