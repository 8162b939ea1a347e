"""Problem 5: personal information in free text, found by weak supervision.

Generators propose spans of five kinds. For each kind a set of labelers (patterns, gazetteers, context)
votes for or against every candidate or abstains. Expectation-maximisation over the votes of a bounded
sample estimates how far each labeler can be trusted, and a logistic span classifier is trained on the
votes and the shape of the candidates with the resulting probabilities. It decides about every candidate
of every text. Surnames, further given names and ordinary words are counted over all texts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Texts of the training sample, at most, and their greatest length: both bound what the driver holds.
SAMPLE_LENGTH = 20_000
SAMPLE_TEXTS = 6000
#: A word is an ordinary one and no surname from so many occurrences in small letters: at least the first, and that share of all words in small letters.
PLAIN_LEAST = (2, 2e-5)
#: The same for surnames, of all words beside given names, and for given names, of all words after cues.
SURNAME_LEAST, GIVEN_LEAST = (2, 1e-5), (3, 1e-5)
KINDS = ("email", "direccion", "documento", "telefono", "nombre")
PLACEHOLDERS = {"email": "[EMAIL]", "direccion": "[DIRECCION]", "documento": "[DOCUMENTO]", "telefono": "[TELEFONO]", "nombre": "[NOMBRE]"}

# Frequent given names, street words, digits in words and cues.
GIVEN = (
    "adela adrián agustín aitana aitor alba alberto alejandra alejandro alfonso alfredo alicia álvaro amalia amelia amparo ana andrés ángela antonia antonio"
    " aurora beatriz begoña belén benito bernardo blanca bruna carla carlos carmela carmen carolina catalina cecilia celia clara claudia concepción consuelo"
    " cristina cristóbal daniel david diego dolores domingo eduardo elena elías elisa emilia emilio encarnación enrique ernesto esperanza esteban estela esther"
    " eugenia eugenio eva fátima federico felipe félix fernando francisca francisco gabriel gabriela gerardo gloria gonzalo gregorio guadalupe guillermo hugo"
    " ignacio iker inés irene isabel iván jacinta jaime javier jesús joaquín jorge josé josefa juan juana julia julián julio laura lázaro leonor lola lorenzo"
    " lourdes lucas lucía luis luisa magdalena manuel manuela marcos margarita maría mariana maricruz marina mario marta martín mateo matilde mercedes miguel"
    " miriam mónica montserrat nahuel natalia nicolás nieves noelia noemí nuria olena olga óscar pablo paloma patricia paula pedro pilar rafael ramón raquel raúl"
    " ricardo roberto rocío rodrigo rosa rosario rubén rufino sabina salvador samuel sandra santiago sara saúl sebastián sergio silvia sofía soledad susana teo teresa"
    " tomás valentina vanesa verónica vicente víctor violeta virginia ximena yolanda"
).split()
FOREIGN_GIVEN = (
    "andrew anna anne barbara camille catherine charles chloé christine dieter edward élise elizabeth emily emma fernanda françois francesca franz friedrich"
    " george giovanni giulia giuseppe hannah hans heinrich helga henry henrique ingrid isabelle jacques james jean jennifer joão johann john joseph jürgen"
    " karen karl klaus laurent linda luísa luca margaret marie mary matteo michael michel monika nancy nicolas otto paolo patrick paul paulo peter petra philippe"
    " pierre renate richard robert sabine sarah sophie stefan stephen susan thomas thérèse ursula walter werner william wolfgang"
).split()
STREETS = (
    "calle avenida avda avda. av. plaza pza. paseo camino carretera ctra. ronda travesía callejón glorieta alameda c/ bulevar calzada jirón"
    " carrer avinguda plaça passeig rambla rua travessa praça estrada via viale piazza corso"
).split()
DIGIT_WORDS = "cero uno dos tres cuatro cinco seis siete ocho nueve".split()
TITLES = "don doña d. dª dr. dra. sr. sra. señor señora srta. lic. prof. ing. fray sor mr. mrs. ms. miss mme. madame monsieur herr frau senhor senhora signor signora".split()
INTRODUCTIONS = (
    "me llamo|se llama|se llamaba|llamado|llamada|conoces a|conocí a|pregunta por|preguntó por|firmado por|firmado:|firma:|nombre:|datos:|atentamente,|my name is|i am called|signed by"
    "|ich heiße|er heißt|sie heißt|je m'appelle|il s'appelle|elle s'appelle|em dic|meu nome é|me chamo|mi chiamo|me dic|меня зовут|με λένε"
).split("|")
RELATIVES = "vecina vecino prima primo hermana hermano tía tío amiga amigo hija hijo abuela abuelo madre padre suegra suegro sobrina sobrino nieta nieto compañera compañero jefa jefe".split()
#: Words before a person that come before much else too.
WEAK_CUES = ("y con", "con", "ni", "a", "ay,", "para", "por", "entre")
PERSON_CUES = (*INTRODUCTIONS, *TITLES, *(f"{w} {r}" for w in ("mi", "su", "tu") for r in RELATIVES), *WEAK_CUES)
#: Cues after which even an unknown capitalised word is proposed as a name.
STRONG_CUES = [c for c in PERSON_CUES if c not in WEAK_CUES and (len(c) > 5 or c in ("doña", "dr.", "dra.", "mr.", "mrs.", "ms.", "mme.", "frau", "herr", "sra.", "prof."))]
NO_PERSON = frozenset("río calle avenida avda av plaza paseo camino virgen san santa santo cooperativa radio hotel bar colegio hospital barrio pueblo sierra monte puente editorial hilados fundación asociación banco grupo del al el la los las un una".split())
PERSON_AFTER = re.compile(
    r"\s+(?:(?:me|te|se|le|les|nos|no|ya|siempre|nunca|también)\s+)*[a-záéíóúñ]+(?:aba|aban|ía|ían|ó|jo|ieron|aron)\b|[\s,]+que en paz|\s+(?:y|i|e|und|et|and|ni|no|con)\s|\s*[/(]|[?!,.»]", re.I
)
WORD_AFTER = re.compile(r"\s+(?:era|eran|es|son|fue|de|del|en|y)\s+(?:el|la|un|una|los|las)\b|\s+(?:de|del)\s", re.I)

#: From here on letters stand without blanks between words.
IDEOGRAPHS = "\u2e80"
_UP, _LOW = "A-ZÁÉÍÓÚÀÈÌÒÙÄËÏÖÜÂÊÎÔÛÃÕÑÇ", "a-záéíóúàèìòùäëïöüâêîôûãõñçß"
_L = _UP + _LOW
_BLANK = "[ \xa0\u2000-\u200a\u202f]"
_NAME_WORD = rf"[{_UP}][{_L}'’]+(?:-[{_UP}][{_L}'’]+)?"
_PARTICLE = rf"(?:de{_BLANK}(?:la|los|las)|del|de|da|do|dos){_BLANK}+"
_AFTER_GIVEN = re.compile(rf"{_BLANK}+({_PARTICLE})?([{_L}][{_L}'’]*(?:-[{_L}][{_L}'’]*)?)")
_BEFORE_COMMA = re.compile(rf"([{_L}][{_L}'’\-]+){_BLANK}+([{_L}][{_L}'’\-]+),{_BLANK}*$")
_ONE_BEFORE_COMMA = re.compile(rf"([{_L}][{_L}'’\-]+),{_BLANK}*$")
_INITIALS = re.compile(rf"(?<![{_L}\d.@\-º])(?<!\d[ \xa0])(?<![º\-/][ \xa0])(?:[{_UP}]\.{_BLANK}?){{1,3}}{_BLANK}*(?:{_PARTICLE})?{_NAME_WORD}(?:{_BLANK}+{_NAME_WORD})?")
_UNKNOWN = re.compile(rf"{_BLANK}+({_NAME_WORD}(?:{_BLANK}+(?:{_PARTICLE})?{_NAME_WORD}){{0,2}}(?:,{_BLANK}{_NAME_WORD})?)")
_SMALL_INITIALS = re.compile(rf"{_BLANK}+((?:[{_LOW}]\.{_BLANK}){{1,3}}([{_LOW}]+))")
_AT = r"(?:[@＠]|[ \xa0]?[\[({](?:at|arroba)[\])}][ \xa0]?|[ \xa0]+arroba[ \xa0]+)"
_DOT = r"(?:\.|[ \xa0]+punto[ \xa0]+|[ \xa0]?[\[({](?:dot|punto)[\])}][ \xa0]?)"
_EMAIL = re.compile(rf"(?<![A-Za-z0-9._+\-])[A-Za-z0-9](?:[A-Za-z0-9._+\-]*[A-Za-z0-9_+\-])?{_AT}[A-Za-z0-9\-]+(?:{_DOT}[A-Za-z0-9\-]+)*{_DOT}[A-Za-z]{{2,}}", re.I)
_SEP = "[ \xa0.\\-]"
_PHONE = re.compile(
    rf"(?<![\d/.,#+\-])(?<![\d#][ \xa0])(?:(?:\(\+?\d{{1,3}}\)|\+\d{{1,3}}|00\d{{2}}){_SEP}?)?"
    rf"(?:(?<=\(\d{{2}}\)[ \xa0])\d{{3}}{_SEP}\d{{2}}{_SEP}\d{{2}}|\d{{9}}|\d{{3}}({_SEP})\d{{3}}\1\d{{3}}|\d{{3}}{_SEP}\d{{2}}{_SEP}\d{{2}}{_SEP}\d{{2}}|\d{{2}}{_SEP}\d{{4}}{_SEP}\d{{4}}|\d{{2}}{_SEP}\d{{3}}{_SEP}\d{{2}}{_SEP}\d{{2}})(?![\d/]|[.\-][\dA-Za-z]|[A-Za-z])"
)
_DIGIT = rf"(?:{'|'.join(DIGIT_WORDS)})"
_PHONE_WORDS = re.compile(rf"(?<![{_L}]){_DIGIT}(?:[\s,\-]+{_DIGIT}){{6,11}}(?![{_L}])", re.I)
_DOCUMENT = re.compile(
    r"(?<![\w.\-/#])(?:\d{8}(?:-?[A-Za-z]|[ \xa0][A-Z])|\d{2}\.\d{3}\.\d{3}[ \xa0\-]?[\dA-Za-z]|[XYZxyz][ \xa0\-]?\d{7}[ \xa0\-]?[A-Za-z]|[A-Za-z]{2,3}\d{6}|\d{2}[/\- ]\d{8}[/\- ]\d{2})(?![\w/]|\.\d)"
)
_STREET_WORD = re.compile(rf"(?:{_BLANK}+|(?<=/){_BLANK}*)(?:(?:de|del|la|los|las|el|y|da|do|das|dos|di|della|dels|les)(?![{_L}])|[{_UP}][{_L}'’\-]*)")
_HOUSE = re.compile(
    rf",?{_BLANK}*(?:s/n|S/N|[nN]\.?{_BLANK}?[ºo°]\.?{_BLANK}*\d+|[nN]úm(?:ero|\.)?{_BLANK}*\d+|[kK][mM]\.?{_BLANK}*\d+(?:[.,]\d+)?|#{_BLANK}?\d+(?:-\d+)?|\d{{1,4}}(?:-\d+)?(?![\d%€])(?![.,]\d))"
)
_FLOOR = re.compile(rf",?{_BLANK}*(?:bajo|ático|entlo\.?|\d{{1,2}}\.?[ºª°]{_BLANK}*(?:(?:izda|dcha|izq)\.?|[A-Z](?![{_L}])))")
_TOWN = re.compile(rf",{_BLANK}*\d{{5}}{_BLANK}+[{_UP}][{_L}]+(?:{_BLANK}+(?:de{_BLANK}+)?[{_UP}][{_L}]+)?|,{_BLANK}*[{_UP}][{_LOW}]+(?:{_BLANK}+(?:de{_BLANK}+)?[{_UP}][{_LOW}]+)?(?=,|{_BLANK}|\.|$)")
_RUN = re.compile(r"\d[\d\xa0 .\-/()]{5,}")
#: Telephones of any country: a prefix and groups, an area in brackets, a trunk zero, or three, three and four digits.
_ANY_PHONE = re.compile(
    rf"(?<![\w/.,#+\-])(?:(?:\+|00)\d{{1,3}}(?:{_SEP}?\(\d{{1,4}}\))?(?:[ \xa0.\-/]?\d{{1,4}}){{2,6}}|\(0?\d{{2,4}}\){_SEP}?\d{{2,4}}(?:{_SEP}\d{{2,4}}){{1,3}}"
    rf"|0\d(?:{_SEP}\d\d){{4}}|0\d{{2,4}}[ \xa0/\-]\d{{5,8}}|\d{{3}}([.\-])\d{{3}}\1\d{{4}})(?![\d/]|[.\-][\dA-Za-z]|[A-Za-z])"
)
#: Numbers of other countries: groups of three, two and four; letters, six digits and a key; a long number after a cue.
_ANY_DOCUMENT = re.compile(r"(?<![\w.\-/#+])(?:\d{3}-\d{2}-\d{4}|[A-Z]{4}\d{6}[A-Z]{6}[\dA-Z]\d|[A-ZÑ&]{3,4}\d{6}[\dA-Z]{3}|[A-HJNPQRSUVW]-?\d{7}[\dA-J]|\d{1,2}\.\d{3}\.\d{3}-[\dkK]|\d\.\d{3}\.\d{3})(?![\w/]|[.\-]\d)")
_CUED_DOCUMENT = re.compile(r"(?:[A-Z]{1,3}[ \-]?)?\d{6,12}(?:-?[A-Z\d])?(?![\w/]|[.\-]\d)")
DOCUMENT_WORDS = "dni nie nif cif cédula cedula pasaporte passport reisepass passeport passaporte ausweis personalausweis ssn".split()
_DOCUMENT_LINK = re.compile(r"(?:\s+(?:n[º°o.]+|núm\.?|nr\.?|no\.?|number|número|de identidad))?[\s:.]{1,3}", re.I)
#: Addresses with the number first or the word for the street last.
_STREET_LAST = re.compile(
    rf"(?<![\w.,])\d{{1,5}}[A-Za-z]?{_BLANK}+(?:[{_UP}][{_L}'’.\-]*{_BLANK}+){{1,4}}(?:Street|St\.|Road|Rd\.?|Avenue|Ave\.?|Lane|Ln\.?|Drive|Boulevard|Blvd\.?|Court|Square|Terrace|Crescent|Close|Place|Way)(?![{_L}])"
    rf"|(?<![\w.,])\d{{1,4}}(?:{_BLANK}?(?:bis|ter))?,?{_BLANK}+(?:rue|avenue|boulevard|place|chemin|impasse|quai|allée|cours){_BLANK}+(?:(?:de|du|des|la|le|les){_BLANK}+|de{_BLANK}l['’]|d['’]|l['’])*[{_UP}][{_L}'’\-]+(?:{_BLANK}+[{_UP}][{_L}'’\-]+)*"
    rf"|(?<![{_L}])[{_UP}][{_L}\-]+(?:straße|strasse|str\.|weg|gasse|platz|allee|ufer|damm){_BLANK}+\d{{1,4}}[a-z]?(?![\d{_L}])"
)
STREET_HINTS = "street st. road rd ave avenue lane ln drive boulevard blvd court square terrace crescent close place way rue chemin impasse quai allée cours straße strasse str. weg gasse platz allee ufer damm".split()
EMAIL_CUE = re.compile(r"(?:correo|escr[ií]b|mail|adress|email|write|schreib|contact|邮箱|連絡|/|\()", re.I)
PHONE_CUE = re.compile(r"(?:tel[eéè]?f?\w*\.?|móvil|número|numéro|phone|number|call|llám\w*|al|luego|/|:|电话是?|電話は?|nummer|era|le|el|is|ist|то|\()[\s:,]*(?:el |le |al |the )?$", re.I)
DOCUMENT_CUE = re.compile(r"(?:dni|nie|nif|cif|pasaporte|passport|documento|identidad|identity|cédula|seguridad social|social security|papeles|carn[eé]t?|ficha|tarjeta|número|ssn|ausweis|era|con)[\s:,]*(?:\w+\s+){0,2}$", re.I)
NUMBER_NO = re.compile(r"(?:expediente|lotes?|ref\.?|núm\.|pág\.|art\.|cap\.|fig\.|vol\.|n\.º|censo|factura|pedido)\s*(?:\w+\s+)?$", re.I)
AFTER_NO = re.compile(r"\s*(?:euros?|€|%|por ciento|personas|kg|km|m\b|años|habitantes)", re.I)
PLACE_CUE = re.compile(r"(?:en|a|de|cerca de|junto a|vive en|años en|mudamos a|cartas en|at|in|to|à|em)\s*(?:la\s+)?$", re.I)

Span = tuple[int, int, str, tuple, tuple]


_ACUTE = str.maketrans("áéíóúü", "aeiouu")


def _bare(word: str) -> str:
    """A word without acute accents and small."""
    return word.lower().translate(_ACUTE)


def _lowered(text: str) -> str:
    """The text in small letters, of the same length."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


class Finder:
    """Candidates of a text with the votes of their labelers, and the classifier's decision."""

    def __init__(self, surnames: frozenset[str] = frozenset(), givens: frozenset[str] = frozenset(), common: frozenset[str] = frozenset(), weights: dict[str, dict] | None = None, plain: frozenset[str] | None = None) -> None:
        self.surnames, self.common, self.weights, self.plain = surnames, common, weights or {}, plain
        self.givens = frozenset(_bare(g) for g in (*GIVEN, *FOREIGN_GIVEN)) | givens
        self.known: dict[tuple, bool] = {}
        machine = ahocorasick.Automaton()
        givens = {v for g in {*GIVEN, *FOREIGN_GIVEN, *self.givens} for v in (g, _bare(g))}
        signs = ("@", "＠", "arroba", "[at]", "(at)", "{at}")
        for kind, words in (("g", givens), ("s", STREETS), ("d", DIGIT_WORDS), ("c", STRONG_CUES), ("n", DOCUMENT_WORDS), ("l", STREET_HINTS), ("@", signs)):
            for w in words:
                machine.add_word(w, machine.get(w, "") + kind)
        for w in list(machine.keys()):
            machine.add_word(w, (machine.get(w), len(w)))
        machine.make_automaton()
        self.machine = machine

    def settings(self) -> tuple:
        return self.surnames, self.givens, self.common, self.weights, self.plain

    def candidates(self, text: str) -> Iterator[Span]:
        """(start, end, kind, votes, shape) of every candidate."""
        low = _lowered(text)
        hits = list(self.machine.iter(low))
        digits_in_words, mails, last = 0, [], 0
        for at, (kinds, size) in hits:
            if "@" in kinds and at >= last:
                s = at + 1 - size
                while s > last and text[s - 1] in " \xa0[({":
                    s -= 1
                e = s
                while s > last and (text[s - 1].isascii() and text[s - 1].isalnum() or text[s - 1] in "._+-"):
                    s -= 1
                while s < e and not text[s].isalnum():
                    s += 1
                m = _EMAIL.match(text, s) if s < e else None
                if m:
                    last = m.end()
                    mails.append(m.span())
                    yield self.email(text, m)
        k, hinted = 0, False
        for end, (kinds, size) in hits:
            start, after = end + 1 - size, end + 1
            while k < len(mails) and mails[k][1] <= start:
                k += 1
            if "@" in kinds or k < len(mails) and mails[k][0] <= start:
                continue  # names inside an address are none
            if "l" in kinds and not low[after : after + 1].isalpha():
                hinted = True
            if start and low[start - 1].isalpha() and low[start - 1] < IDEOGRAPHS or after < len(low) and low[end].isalpha() and low[after].isalpha() and low[after] < IDEOGRAPHS:
                continue
            if "d" in kinds:
                digits_in_words += 1
            if "s" in kinds:
                found = self.street(text, start, after)
                if found:
                    yield found
            if "n" in kinds:
                link = _DOCUMENT_LINK.match(text, after)
                m = _CUED_DOCUMENT.match(text, link.end()) if link else None
                if m:
                    yield self.number(text, m, "documento", "cued")
            if "g" in kinds:
                found = self.person(text, start, after)
                if found:
                    yield found
            if "c" in kinds:
                m = _SMALL_INITIALS.match(text, after)
                if m and self._small_surname(_bare(m.group(2))):
                    yield self.named(text, m.start(1), m.end(), "initials") or (0, 0, "nombre", (0,), ("",))
                m = _UNKNOWN.match(text, after)
                if m and _bare(re.split(r"[\s\xa0,]", m.group(1))[0]) not in self.givens and _bare(re.split(r"[\s\xa0]", m.group(1))[-1]) not in self.givens:
                    found = self.named(text, m.start(1), m.end(1), "unknown")
                    if found:
                        yield found
        for m in _INITIALS.finditer(text):
            found = self.named(text, m.start(), m.end(), "initials")
            if found:
                yield found
        for run in _RUN.finditer(text):
            if sum(c.isdigit() for c in run.group()) < 6:
                continue
            region = max(0, run.start() - 8), run.end() + 4
            for m in _PHONE.finditer(text, *region):
                yield self.number(text, m, "telefono")
            for m in _DOCUMENT.finditer(text, *region):
                yield self.number(text, m, "documento")
            for m in _ANY_PHONE.finditer(text, *region):
                yield self.number(text, m, "telefono", "general")
            for m in _ANY_DOCUMENT.finditer(text, *region):
                yield self.number(text, m, "documento", "general")
        if hinted:
            for m in _STREET_LAST.finditer(text):
                yield m.start(), m.end(), "direccion", (1, 1, 1 if PLACE_CUE.search(text[max(0, m.start() - 14) : m.start()]) else 0, -1 if AFTER_NO.match(text, m.end()) else 0), ("last",)
        if digits_in_words >= 7:
            for m in _PHONE_WORDS.finditer(text):
                yield self.number(text, m, "telefono")

    def email(self, text: str, m: re.Match) -> Span:
        value, before = m.group(), text[max(0, m.start() - 25) : m.start()]
        votes = (1, 1 if "." in value or "punto" in value.lower() else -1, 1 if EMAIL_CUE.search(before) else 0)
        return m.start(), m.end(), "email", votes, ("plain" if "@" in value or "＠" in value else "spelled",)

    def number(self, text: str, m: re.Match, kind: str, shape: str = "") -> Span:
        s, e = m.span()
        value = m.group()
        before, after = text[max(0, s - 28) : s], text[e : e + 14]
        figures = sum(c.isdigit() for c in value)
        no = -1 if NUMBER_NO.search(before) or AFTER_NO.match(after) else 0
        if kind == "telefono":
            words = figures == 0
            form = "words" if words else "prefix" if value[0] in "(+" or value.startswith("00") else "plain" if value.isdigit() else "grouped"
            first = value[0] in "6789" or form in ("prefix", "words")
            votes = (1 if form == "prefix" else 0, 1 if form != "prefix" and first else -1 if not first else 0, 1 if PHONE_CUE.search(before) else 0, no, 1 if words or 9 <= figures <= 15 else -1)
        else:
            letter = any(c.isalpha() for c in value)
            form = "slashes" if "/" in value else "dots" if "." in value else "letter" if letter else "digits"
            votes = (1 if letter or form in ("slashes", "dots") else 0, 1 if DOCUMENT_CUE.search(before) else 0, no, 1 if 6 <= figures <= 12 else -1)
        if shape == "general" and kind == "telefono":
            votes = (1, 0, *votes[2:])  # its form is a telephone's
        elif shape:
            votes = (1, 1 if shape == "cued" else votes[1], *votes[2:])
        return s, e, kind, votes, (shape or form,)

    def street(self, text: str, s: int, e: int) -> Span | None:
        """An address from a street word at text[s:e]: words of the name, then a house number; else None."""
        at, words, capitals = e, 0, 0
        while True:
            m = _STREET_WORD.match(text, at)
            if not m:
                break
            at, words, capitals = m.end(), words + 1, capitals + m.group().strip()[0].isupper()
        m = _HOUSE.match(text, at)
        if not m:
            return None
        end = m.end()
        for more in (_FLOOR, _TOWN):
            m = more.match(text, end)
            end = m.end() if m else end
        before = text[max(0, s - 14) : s]
        votes = (1, 1 if capitals else -1, 1 if PLACE_CUE.search(before) else 0, -1 if AFTER_NO.match(text, end) else 0)
        return s, end, "direccion", votes, ("capital" if capitals else "small",)

    def surname(self, word: str, capital: bool) -> bool:
        parts = word.split("-")
        if capital:
            return all(p and p[0].isupper() for p in parts)
        return all(self._small_surname(_bare(p)) for p in parts)

    def _small_surname(self, word: str) -> bool:
        """A learned surname, or a word of four letters that the sample hardly has in small letters."""
        return word in self.surnames or self.plain is not None and len(word) >= 4 and word not in self.plain

    def person(self, text: str, s: int, e: int) -> Span | None:
        """The whole name around a given name at text[s:e]."""
        capital = text[s].isupper()
        end, taken = e, 0
        while True:
            m = _AFTER_GIVEN.match(text, end)
            if not m or m.group(1) and taken:
                break
            if taken >= 2 and _bare(m.group(2)) not in self.surnames:
                break
            if not self.surname(m.group(2), capital or m.group(2)[0].isupper() and m.group(2).isupper()):
                if not (capital and _bare(m.group(2).split("-")[0]) in self.surnames and taken == 0):
                    break
            if _bare(m.group(2)) in self.givens and taken:
                break
            end, taken = m.end(), taken + 1
        start = s
        if not taken:
            before = text[max(0, s - 60) : s]
            m = _BEFORE_COMMA.search(before)
            if m and all(self.surname(w, capital) and _bare(w) not in self.givens for w in m.groups()):
                lead = text[max(0, s - len(before) + m.start() - 16) : s - len(before) + m.start()].split()
                if not (lead and (_bare(lead[-1]) in self.givens)):
                    start, taken = s - len(before) + m.start(), 2
            else:
                m = _ONE_BEFORE_COMMA.search(before)
                if m and _bare(m.group(1)) in self.surnames and self.surname(m.group(1), capital):
                    lead = text[max(0, s - len(before) + m.start() - 16) : s - len(before) + m.start()].split()
                    if not (lead and (_bare(lead[-1]) in self.givens or _bare(lead[-1]) in self.surnames or lead[-1].endswith("."))):
                        start, taken = s - len(before) + m.start(), 1
        return self.named(text, start, end, "given" if not taken else "full", text[s:e])

    def named(self, text: str, s: int, e: int, form: str, given: str = "") -> Span | None:
        """A name with its votes; None for a place, a firm, a saint or a piece of an address."""
        value = text[s:e]
        capital = value[0].isupper()
        before = text[max(0, s - 24) : s]
        flat = before.lower().replace("\xa0", " ").rstrip("«“\"'( ")
        cue = next((c for c in PERSON_CUES if flat.endswith(c) and (len(flat) == len(c) or not flat[-len(c) - 1].isalnum())), "")
        last = re.search(rf"([{_L}]+)\W*$", before)
        word = last.group(1).lower() if last else ""
        opens = not before.strip() or before.rstrip()[-1:] in ".!?…:;»”—-" or "\n" in before[len(before.rstrip()) :]
        known = [p for p in re.split(r"[\s\xa0,\-.]+", value) if p and _bare(p) in self.surnames]
        ambiguous = _bare(given) in self.common if given else False
        blocked = word in NO_PERSON and not cue.endswith((".", ":")) and not (cue and len(cue) > 3)
        strong = cue and cue not in WEAK_CUES and cue != "d."
        part_of_address = before[-1:] in ("@", "＠", "_") or text[e : e + 1] in ("@", "＠", "_")
        if blocked or part_of_address:
            return None
        votes = (
            1 if given else 0,  # gazetteer of given names
            1 if form in ("full", "initials") and (known or capital) else 0,  # a surname too
            1 if strong else 0,  # context before
            1 if PERSON_AFTER.match(text, e) and (capital or strong) else -1 if form == "given" and WORD_AFTER.match(text, e) else 0,  # context after
            1 if capital and not opens else -1 if not capital and form == "given" and not strong else 0,  # case
            -1 if form == "initials" and not known and not strong else 0,  # the end of a sentence
            -1 if ambiguous and form == "given" and not strong and (opens and not PERSON_AFTER.match(text, e) or not capital) else 0,  # common word
            1 if known else 0,  # learned surname
        )
        return s, e, "nombre", votes, (form, "capital" if capital else "small", "cue" if strong else "weak" if cue else "none")

    def accepts(self, kind: str, votes: tuple, shape: tuple) -> bool:
        key = (kind, votes, shape)
        found = self.known.get(key)
        if found is None:
            weights = self.weights.get(kind, {})
            found = self.known[key] = sum(weights.get(f, 0.0) for f in _features(votes, shape)) > 0
        return found

    def mentions(self, text: str | None) -> list[tuple[int, int, str]]:
        """(start, end, kind) of the mentions of a text in order, none of which overlap."""
        if not text:
            return []
        chosen = [(KINDS.index(k), s - e, s, e) for s, e, k, v, f in self.candidates(text) if self.accepts(k, v, f)]
        if not chosen:
            return []
        chosen.sort()
        out: list[tuple[int, int, str]] = []
        for rank, _, s, e in chosen:
            if all(e <= a or s >= b for a, b, _ in out):
                out.append((s, e, KINDS[rank]))
        out.sort()
        return out

    def replaced(self, text: str | None) -> str | None:
        """The text with a placeholder of its kind for every mention, and all else as it was."""
        found = self.mentions(text)
        if not found:
            return text
        parts, at = [], 0
        for s, e, kind in found:
            parts += [text[at:s], PLACEHOLDERS[kind]]
            at = e
        return "".join([*parts, text[at:]])


def _features(votes: tuple, shape: tuple) -> list[str]:
    return ["", *(f"v{i}{v:+d}" for i, v in enumerate(votes)), *(f"s{i}{s}" for i, s in enumerate(shape))]


def aggregate_votes(votes: np.ndarray, weight: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """(probability that each candidate is a mention, reliability of each labeler), by EM.

    A labeler that votes is right with its reliability, which has a Beta(17, 3) prior; abstentions tell
    nothing. No labeler is trusted beyond 0.95, so that two good ones can outvote any. Starts from the majority.
    """
    reliability = np.full(votes.shape[1], 0.85)
    prior = 0.5
    p = np.full(len(votes), 0.5)
    for _ in range(rounds):
        odds = np.log(prior / (1 - prior)) + votes @ np.log(reliability / (1 - reliability))
        p = 1 / (1 + np.exp(-odds))
        right = np.where(votes > 0, p[:, None], np.where(votes < 0, 1 - p[:, None], 0)) * weight[:, None]
        cast = (votes != 0) * weight[:, None]
        reliability = np.clip((right.sum(axis=0) + 17) / (cast.sum(axis=0) + 20), 0.55, 0.95)
        prior = float(np.clip((p * weight).sum() / weight.sum(), 0.05, 0.95))
    return p, reliability


def _fit(rows: list[tuple[tuple, tuple]], p: np.ndarray, weight: np.ndarray, l2: float = 0.3) -> dict[str, float]:
    """Logistic regression on the votes and the shape, towards the probabilities ``p``."""
    index: dict[str, int] = {}
    columns = [[index.setdefault(f, len(index)) for f in _features(v, s)] for v, s in rows]
    x = np.zeros((len(rows), len(index)))
    for row, cols in zip(x, columns):
        row[cols] = 1
    beta = np.zeros(len(index))
    for _ in range(60):
        q = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x.T * (weight * q * (1 - q))) @ x + l2 * np.eye(len(beta)), x.T @ (weight * (p - q)) - l2 * beta)
        beta += step
        if np.abs(step).max() < 1e-7:
            break
    return {f: float(beta[i]) for f, i in index.items()}


# Sentences that every finder is trained on besides its sample, so that no form of a mention is without an example.
SEED = (
    "Call (212) 555-0147 or 415-555-0132. My number is +44 20 7946 0958. Tel. 030 1234567. Téléphone: 01 23 45 67 89. Telefone +351 912 345 678.",
    "His SSN was 078-05-1120. Passport number 123456789. La cédula 1.234.567 y el NIF 123456789 constan. RUT 9.876.543-K. DNI: 12345678Z.",
    "She lives at 12 Main Street. He moved to 48 Old Mill Road in May. Il habite 5, rue de la Paix. Sie wohnt in der Hauptstraße 12. Vivo en la calle Real 8. Mora na rua Direita, 14. Abita in via Roma 3.",
    "Mr. Brown called. My name is Peter Brown. Frau Schmidt und Klaus Meier kamen. Mme. Dubois et Pierre Dubois dormaient. Mi tía Julia Romero reía. Dr. Watson agreed.",
    "Write to peter.brown@mail.example or julia (arroba) correo (punto) example.",
)
_PAIR = re.compile(rf"(?<![{_L}])({_NAME_WORD}){_BLANK}+(?:{_PARTICLE})?({_NAME_WORD})(?:{_BLANK}+({_NAME_WORD}))?")
_INITIAL_AND_NAME = re.compile(rf"(?<![{_L}.])[{_UP}]\.{_BLANK}(?:[{_UP}]\.{_BLANK})?({_NAME_WORD})(?={_BLANK}+[{_LOW}])")
_ARTICLE = re.compile(rf"\b(?:[Ee]l|[Ll]a|[Ll]os|[Ll]as|[Uu]n|[Uu]na|[Cc]on|[Dd]e|[Dd]el|[Ss]in)\s+([{_LOW}]+)")
_SMALL = re.compile(rf"(?<![{_L}@.+\-])[{_LOW}]+")
_AFTER_CUE = re.compile(rf"{_BLANK}+({_NAME_WORD})((?:{_BLANK}+{_NAME_WORD}){{0,2}})(?:,{_BLANK}({_NAME_WORD}))?")


@lru_cache(maxsize=1)
def _cues() -> ahocorasick.Automaton:
    machine = ahocorasick.Automaton()
    for c in STRONG_CUES:
        machine.add_word(c, len(c))
    machine.make_automaton()
    return machine


def _first_counts(texts: Iterable[str | None]) -> Counter:
    """(kind, word): words in small letters, first and second words of names after cues."""
    small, out = Counter(), Counter()
    for t in texts:
        if t:
            small.update(_SMALL.findall(t))
            low = _lowered(t)
            for end, size in _cues().iter(low):
                if end >= size and low[end - size].isalpha():
                    continue  # within a word
                m = _AFTER_CUE.match(t, end + 1)
                if m is None:
                    continue
                out["first", _bare(m.group(3) or m.group(1))] += 1
                out.update(("second", _bare(w)) for w in (m.group(1) if m.group(3) else "", *m.group(2).split()) if w)
    for w, k in small.items():
        out["small", _bare(w)] += k
    return out


def _second_counts(texts: Iterable[str | None], givens: frozenset[str]) -> Counter:
    """(kind, word): words beside given names and after initials, given names in small letters after an article."""
    out: Counter = Counter()
    after_article: Counter = Counter()
    for t in texts:
        if not t:
            continue
        for m in _PAIR.finditer(t):
            if _bare(m.group(1)) in givens:
                out.update(("surname", _bare(x)) for w in m.groups()[1:] for x in (w or "").split("-") if x)
        out.update(("surname", _bare(w)) for w in _INITIAL_AND_NAME.findall(t))
        after_article.update(_ARTICLE.findall(t))
    for w, k in after_article.items():
        if _bare(w) in givens:
            out["common", _bare(w)] += k
    return out


def _least(bounds: tuple[int, float], total: int) -> float:
    return max(bounds[0], bounds[1] * total)


class Words:
    """Given names beyond the fixed ones, surnames, given names that are words too, and ordinary words."""

    def __init__(self, givens=frozenset(), surnames=frozenset(), common=frozenset(), plain=None) -> None:
        self.givens, self.surnames, self.common, self.plain = givens, surnames, common, plain


def _given_names(first: dict, second: dict, small: dict, total: int) -> frozenset[str]:
    return frozenset(w for w, k in first.items() if k >= _least(GIVEN_LEAST, total) and k > 2 * second.get(w, 0) and small.get(w, 0) <= k / 4)


def _by_kind(counts: Iterable[tuple[str, str, int]]) -> dict[str, dict[str, int]]:
    out: dict[str, dict[str, int]] = {}
    for kind, word, n in counts:
        out.setdefault(kind, {})[word] = n
    return out


def _words(count_first, count_second) -> Words:
    """The words from two counts, the second made with the given names of the first.

    Each gives (rows (kind, word, n), total of each kind); only words over the least shares need be among the rows.
    """
    rows, totals = count_first()
    kinds = _by_kind(rows)
    small = kinds.get("small", {})
    learned = _given_names(kinds.get("first", {}), kinds.get("second", {}), small, totals.get("first", 0))
    givens = frozenset(_bare(g) for g in (*GIVEN, *FOREIGN_GIVEN)) | learned
    rows, more = count_second(givens)
    kinds = _by_kind(rows)
    surnames = frozenset(
        w for w, k in kinds.get("surname", {}).items() if k >= _least(SURNAME_LEAST, more.get("surname", 0)) and w not in givens and small.get(w, 0) <= k / 2
    )
    plain = frozenset(w for w, k in small.items() if k >= _least(PLAIN_LEAST, totals.get("small", 0)) and len(w) >= 4)
    return Words(learned, surnames, frozenset(kinds.get("common", {})), plain)


def learn_words(texts: DataFrame) -> Words:
    """The words of all of (…, texto): two passes, of counts made by batch and added by word.

    What comes to the driver is bounded: words over a least share of all of their kind, and for those the
    counts in small letters.
    """

    def counted(function) -> tuple[DataFrame, dict[str, int]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = function(batch.column(0).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k for k, _ in found], pa.string()), pa.array([w for _, w in found], pa.string()), pa.array(list(found.values()), pa.int64())], ["clase", "palabra", "n"]
                )

        sums = texts.select("texto").mapInArrow(run, "clase string, palabra string, n long").groupBy("clase", "palabra").agg(F.sum("n").alias("n")).checkpoint()
        totals = {r["clase"]: r["t"] for r in sums.groupBy("clase").agg(F.sum("n").alias("t")).collect()}
        return sums, totals

    def over(sums: DataFrame, totals: dict[str, int], bounds: dict[str, tuple[int, float]]) -> DataFrame:
        keep = F.lit(False)
        for kind, least in bounds.items():
            keep = keep | ((F.col("clase") == kind) & (F.col("n") >= _least(least, totals.get(kind, 0))))
        return sums.where(keep)

    seen: dict[str, DataFrame] = {}

    def first():
        sums, totals = counted(_first_counts)
        seen["small"] = sums
        rows = over(sums, totals, {"first": GIVEN_LEAST, "small": PLAIN_LEAST})
        names = rows.where("clase = 'first'").select("palabra")  # bounded by its least share
        of_names = sums.where("clase <> 'first'").join(F.broadcast(names), "palabra", "left_semi")
        return {tuple(r) for r in rows.select("clase", "palabra", "n").union(of_names.select("clase", "palabra", "n")).collect()}, totals

    def second(givens):
        sums, totals = counted(lambda batch: _second_counts(batch, givens))
        rows = over(sums, totals, {"surname": SURNAME_LEAST, "common": (1, 0.0)})  # common ones are given names
        small = seen["small"].where("clase = 'small'").join(F.broadcast(rows.where("clase = 'surname'").select("palabra")), "palabra", "left_semi")
        ordinary = {r["palabra"]: r["n"] for r in small.collect()}
        rows = [tuple(r) for r in rows.select("clase", "palabra", "n").collect()]
        return [(c, w, n) for c, w, n in rows if c != "surname" or ordinary.get(w, 0) <= n / 2], totals

    return _words(first, second)


def count_words(texts: Iterable[str | None]) -> Words:
    """The same of texts in hand."""
    texts = list(texts)

    def made(counts: Counter):
        totals: Counter = Counter()
        for (kind, _), n in counts.items():
            totals[kind] += n
        return [(k, w, n) for (k, w), n in counts.items()], totals

    return _words(lambda: made(_first_counts(texts)), lambda givens: made(_second_counts(texts, givens)))


def train(texts: Iterable[str | None], words: Words | None = None) -> Finder:
    """A finder from the texts of a sample and the words of all texts (of the sample, if none are given).

    Surnames and further given names are learned from capitalised words beside known given names and after
    strong cues; common words are given names that texts also have in small letters after an article or
    preposition. Then the votes of each kind are aggregated and its classifier is trained.
    """
    texts = [t for t in texts if t]
    words = words or count_words(texts)
    finder = Finder(words.surnames, words.givens, words.common, None, words.plain)
    rows: dict[str, Counter] = {k: Counter() for k in KINDS}
    for t in (*SEED, *texts):
        for _, _, kind, votes, shape in finder.candidates(t):
            rows[kind][votes, shape] += 1
    for kind in KINDS:
        kinds = list(rows[kind]) or [((0,), ("",))]
        weight = np.sqrt(np.array([rows[kind][k] or 1 for k in kinds], dtype=float))
        votes = np.array([v for v, _ in kinds], dtype=float)
        p, _ = aggregate_votes(votes, weight)
        finder.weights[kind] = _fit(kinds, p, weight)
    return Finder(*finder.settings())


def train_on(df: DataFrame, key: str, text: str, words: Words | None = None, sample: int = SAMPLE_TEXTS) -> Finder:
    """A finder from at most ``sample`` texts of the table, none longer than SAMPLE_LENGTH characters.

    They are drawn by a hash of the key, so that the order and the files of the table do not matter.
    """
    part = max(1, df.count() // sample)
    drawn = F.xxhash64(df[key].cast("string"))
    rows = df.where((F.char_length(text) <= SAMPLE_LENGTH) & (F.pmod(drawn, F.lit(part)) == 0)).select(drawn.alias("_h"), text).orderBy("_h").limit(sample).collect()
    return train((r[1] for r in rows), words)


def find_mentions(texts: DataFrame, finder: Finder, keep: tuple[str, ...] = ("tabla", "clave")) -> DataFrame:
    """Columns ``keep``, tipo, inicio, fin: one row per mention, without an exchange."""
    settings = finder.settings()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Finder(*settings)
        for batch in batches:
            rows, kinds, starts, ends = [], [], [], []
            for row, text in enumerate(batch.column("texto").to_pylist()):
                for s, e, kind in own.mentions(text):
                    rows.append(row)
                    kinds.append(kind)
                    starts.append(s)
                    ends.append(e)
            taken = batch.select(list(keep)).take(pa.array(rows, pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [*taken.columns, pa.array(kinds, pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())],
                [*keep, "tipo", "inicio", "fin"],
            )

    types = dict(texts.dtypes)
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in keep), "tipo string, inicio int, fin int"])
    return texts.select(*keep, "texto").mapInArrow(run, schema)


def replace_mentions(texts: DataFrame, finder: Finder, keep: tuple[str, ...] = ("tabla", "clave")) -> DataFrame:
    """Columns ``keep`` and texto with placeholders; null and empty texts stay as they are."""
    settings = finder.settings()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Finder(*settings)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                done = pa.array([own.replaced(t) for t in part.column("texto").to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), done], [*keep, "texto"])

    types = dict(texts.dtypes)
    return texts.select(*keep, "texto").mapInArrow(run, ", ".join([*(f"`{c}` {types[c]}" for c in keep), "texto string"]))
