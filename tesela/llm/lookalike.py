"""Problem 10: one form for texts that look the same."""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Letters of other scripts and the Latin letters they look like, in natural order.
CYRILLIC_CAPITALS = ("АВЕЅІЈКМНОРСТУХҮԌԚԜӀҺ", "ABESIJKMHOPCTYXYGQWIH")
CYRILLIC_SMALLS = ("аеорсухѕіјһԁԛԝӏүԍ", "aeopcyxsijhdqwlyG")
GREEK_CAPITALS = ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹϺ", "ABEZHIKMNOPTYXCM")
GREEK_SMALLS = ("ονϲϳ", "ovcj")
ARMENIAN = ("ՏՍՕօոսցհ", "SUOonugh")
LATIN = ("ɑɡıȷ", "agij")

#: Keys of class members that are broadcast, at most.
BROADCAST_MEMBERS = 500_000
#: Kinds of decomposition that leave what a reader sees as it is.
SAME_LOOK = ("<wide>", "<narrow>", "<noBreak>", "<initial>", "<medial>", "<final>", "<isolated>", "<font>")


def confusable_letters(spark: SparkSession) -> dict[str, str]:
    """Letters of any script that look like a letter of ASCII of the same case, by the confusables of ICU in the session.

    Two characters are confusable if their skeletons are equal. Digits, marks and letters without case are left
    as they are, so that no other sign becomes a letter.
    """
    checker = getattr(spark._jvm.com.ibm.icu.text, "SpoofChecker$Builder")().build()
    letters = [c for c in map(chr, range(0x80, 0x20000)) if unicodedata.category(c) in ("Lu", "Ll") and not unicodedata.decomposition(c)]
    plain = [c for c in map(chr, range(0x41, 0x7B)) if c.isalpha()]
    skeletons = checker.getSkeleton("\n".join([*plain, *letters])).split("\n")
    if len(skeletons) != len(plain) + len(letters):
        skeletons = [checker.getSkeleton(c) for c in (*plain, *letters)]
    of = {(s, unicodedata.category(c)): c for s, c in zip(skeletons, plain)}
    found = ((c, of.get((s, unicodedata.category(c)))) for s, c in zip(skeletons[len(plain) :], letters))
    return {c: a for c, a in found if a}


def character_map(letters: dict[str, str] | None = None) -> dict[int, str | None]:
    """What stands for each character after canonical decomposition; None where it is invisible.

    ``letters`` are look-alike letters besides the fixed ones, as :func:`confusable_letters` gives them.

    By rule over all of Unicode: blanks of any kind become a space; ignorable and format characters,
    variation selectors and control characters (but tab and line ends) vanish; wide, narrow and positional forms and letter
    ligatures fall apart; superscripts, subscripts and fractions stay. Line ends become a line feed.
    """
    out: dict[int, str | None] = {0x2010: "-"}  # the hyphen, of which the non-breaking one is a form
    for code in range(sys.maxunicode + 1):
        if 0xD800 <= code <= 0xDFFF:
            continue
        c = chr(code)
        kind = unicodedata.category(c)
        if kind == "Zs" or c == "\t":
            if c != " ":
                out[code] = " "
            continue
        if kind in ("Zl", "Zp") or c == "\x85":
            out[code] = "\n"
            continue
        if kind == "Cf" or (kind == "Cc" and c not in "\t\n\r") or code == 0x034F or 0xFE00 <= code <= 0xFE0F or 0xE0100 <= code <= 0xE01EF or code in (0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, 0x2800) or 0x180B <= code <= 0x180F:
            out[code] = None
            continue
        parts = unicodedata.decomposition(c).split()
        if not parts or not parts[0].startswith("<"):
            continue
        whole = "".join(chr(int(p, 16)) for p in parts[1:])
        ligature = parts[0] == "<compat>" and len(whole) > 1 and kind in ("Ll", "Lu", "Lt") and whole.isalpha()
        if parts[0] in SAME_LOOK or ligature:
            out[code] = unicodedata.normalize("NFD", unicodedata.normalize("NFKC", c))
    for a, b in (letters or {}).items():
        out[ord(a)] = b
    for pairs in (CYRILLIC_CAPITALS, CYRILLIC_SMALLS, GREEK_CAPITALS, GREEK_SMALLS, ARMENIAN, LATIN):
        for a, b in zip(*pairs):
            out[ord(a)] = b
    for code, text in list(out.items()):  # a wide or styled look-alike letter
        if text:
            out[code] = "".join((out.get(ord(x), x) or "") for x in text)
    return out


_COARSE = re.compile(r"[\W_]+")
_LINE_ENDS = re.compile(r"\r\n?")


class Looks:
    """The one form of texts by a character map. Texts of characters that are their own form alone are told at once."""

    def __init__(self, table: dict[int, str | None]) -> None:
        self.table = table
        own = [c for code in (*range(0x20, 0x250), *range(0x2010, 0x2040), *range(0x3001, 0x3100), *range(0x4E00, 0xA000)) if self._form(c := chr(code)) == c and not unicodedata.combining(c)]
        self.other = re.compile(f"[^\n{re.escape(''.join(own))}]").search

    def _form(self, text: str) -> str:
        return unicodedata.normalize("NFC", unicodedata.normalize("NFD", text).translate(self.table))

    def visible(self, text: str | None) -> str | None:
        if text is None or self.other(text) is None:
            return text
        if "\r" in text:
            text = _LINE_ENDS.sub("\n", text)
        return self._form(text)


@lru_cache(maxsize=1)
def _looks() -> Looks:
    return Looks(character_map())


def visible_form(text: str | None, looks: Looks | None = None) -> str | None:
    """The one form of a text: equal for texts that show a reader the same characters. Null stays null."""
    return (looks or _looks()).visible(text)


def _coarse_digest(form: str) -> bytes:
    """Digest of the letters and digits without case and accents: equal wherever the collation finds two forms equal.

    A text without letters and digits has one of its signs, so that such texts are not all of one digest.
    """
    bare = form.casefold() if form.isascii() else unicodedata.normalize("NFKD", form.casefold())
    return blake2b((_COARSE.sub("", bare) or bare).encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _shown(form: str | None) -> bool:
    return form is not None and form != "" and not form.isspace()


def _table(spark: SparkSession) -> dict[int, str | None]:
    """The character map of the session's ICU: some thousand characters, which go to the workers with their task."""
    return character_map(confusable_letters(spark))


def with_digests(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key`` and the digests of text (huella) and of coarse form (grueso); null and blank texts left out."""

    table = _table(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        looks = Looks(table)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            forms = [looks.visible(t) for t in texts]
            shown = [_shown(f) for f in forms]
            exact = [blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).digest() if s else None for t, s in zip(texts, shown)]
            coarse = [_coarse_digest(f) if s else None for f, s in zip(forms, shown)]
            whole = pa.RecordBatch.from_arrays([batch.column(0), pa.array(exact, pa.binary()), pa.array(coarse, pa.binary())], [key, "huella", "grueso"])
            yield whole.filter(pa.array(shown))

    kind = dict(df.dtypes)[key]
    return df.select(key, df[text].alias("texto")).mapInArrow(run, f"`{key}` {kind}, huella binary, grueso binary")


def with_forms(df: DataFrame) -> DataFrame:
    """(huella, texto) with forma, the visible form."""

    table = _table(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        looks = Looks(table)
        for batch in batches:
            forms = [looks.visible(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(forms, pa.string())], ["huella", "texto", "forma"])

    return df.select("huella", "texto").mapInArrow(run, "huella binary, texto string, forma string")


def look_alike_classes(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Members of the classes with two or more different texts: ``key``, huella, clase, canonico, forma.

    First every document gives two 16-byte digests, of its text and of its coarse form, and only documents
    whose coarse form comes with two or more texts carry a text on. Of each such text one copy is grouped by
    its look-alike-mapped form under the accent- and case-sensitive Unicode collation; the canonical member
    of a class is the text that is in the visible form already, else the least one, and it is joined back.
    ``clase`` names the class by the digest of its canonical member, forma is that member's visible form. ``key`` must be unique.
    """
    digests = with_digests(df, key, text).checkpoint()
    # distinct texts per coarse form, counted without moving a text; copies of one text add no rows
    distinct = digests.groupBy("grueso", "huella").agg(F.min(key).alias("primero"))
    several = distinct.groupBy("grueso").agg(F.count(F.lit(1)).alias("textos")).where("textos > 1").select("grueso")
    first = distinct.join(several, "grueso", "left_semi").select("huella", F.col("primero").alias(key)).checkpoint()
    carried = df.select(key, df[text].alias("texto")).join(first, key).select("huella", "texto")
    collated = with_forms(carried).withColumn("vista", F.collate("forma", "UNICODE")).checkpoint()
    # the deterministic choice: visible form first, then by code point
    choice = F.struct((F.col("texto") != F.col("forma")).alias("otra"), F.col("texto"), F.col("huella"), F.col("forma"))
    classes = (
        collated.groupBy("vista").agg(F.min(choice).alias("primera"), F.count(F.lit(1)).alias("textos"))
        .where("textos > 1").select("vista", F.col("primera.texto").alias("canonico"), F.col("primera.huella").alias("clase"), F.col("primera.forma").alias("forma"))
    )
    members = collated.drop("forma").join(classes, "vista").select("huella", "clase", "canonico", "forma")
    return digests.select(key, "huella").join(members, "huella").checkpoint()


def look_alike_pairs(classes: DataFrame, key: str = "doc_id") -> DataFrame:
    """Every two documents of a class with different texts, the smaller key first.

    Pairs are made of texts first and then spread over the documents that hold them: copies of one text
    are never compared with one another.
    """
    texts = classes.select("clase", "huella").distinct()
    pairs = texts.join(texts.withColumnRenamed("huella", "otra"), "clase").where("huella < otra").select("huella", "otra")
    holders = classes.select(key, "huella")
    one, two = F.col("uno"), F.col("dos")
    return (
        pairs.join(holders.withColumnRenamed(key, "uno"), "huella")
        .join(holders.select(F.col(key).alias("dos"), F.col("huella").alias("otra")), "otra")
        .select(F.least(one, two).alias(f"{key}_a"), F.greatest(one, two).alias(f"{key}_b"))
        .where(F.col(f"{key}_a") < F.col(f"{key}_b"))
        .distinct()
    )


def canonical_texts(df: DataFrame, classes: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, clase, forma: every row in its one form.

    A member of a look-alike class has the form of its canonical member, any other row its own visible
    form; null and blank texts keep theirs and have no class. Up to BROADCAST_MEMBERS keys of members are
    broadcast, so that the other texts stay where they are.
    """
    table = _table(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        looks = Looks(table)
        for batch in batches:
            forms = [looks.visible(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(forms, pa.string())], [key, "forma"])

    kind = dict(df.dtypes)[key]
    members = classes.select(key)
    small = members.count() <= BROADCAST_MEMBERS
    others = df.select(key, df[text].alias("texto")).join(F.broadcast(members) if small else members, key, "left_anti")
    own = others.mapInArrow(run, f"`{key}` {kind}, forma string").select(key, F.lit(None).cast("string").alias("clase"), "forma")
    return own.unionAll(classes.select(key, F.lower(F.hex("clase")).alias("clase"), "forma"))
