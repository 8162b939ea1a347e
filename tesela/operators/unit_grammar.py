"""The rules of :mod:`tesela.operators.grammar` for the built-in tagger, a batch of units at a time.

Every rule stays within a unit, so a unit's words are tagged, parsed and counted in one Arrow kernel, by array
operations over all tokens of a batch. No token table is made, sorted, written or shuffled: what leaves a batch
is a row for each unit, or the counts of the batch. For tokens of another parser the rules are those of ``grammar``.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesela.functions import text as T
from tesela.operators import lexicon_es as es

POS = ("PUNCT", "NUM", "DET", "ADP", "PRON", "AUX", "CCONJ", "SCONJ", "INTJ", "ADV", "VERB", "ADJ", "NOUN")
DEP = ("root", "punct", "det", "nummod", "amod", "case", "nmod", "obl", "nsubj", "obj", "expl", "iobj", "aux", "advmod", "mark", "cc", "discourse", "xcomp", "advcl", "conj", "dep")
PLACES = ("INICIO", "FINAL", "MEDIAL")
_P, _D = {p: k for k, p in enumerate(POS)}, {d: k for k, d in enumerate(DEP)}
_CLITIC = "(?:me|te|se|lo|la|los|las|le|les|nos)?"
_VERB = re.compile(rf"(?:ar|er|ir|ando|iendo|aba|aban|ía|ían|ó|aron|ieron){_CLITIC}\Z")
_INF, _GER, _ADJ = re.compile(rf"(?:ar|er|ir){_CLITIC}\Z"), re.compile(rf"(?:ando|iendo){_CLITIC}\Z"), re.compile(r"(?:oso|osa|able|ible|ico|ica|al|ivo|iva)s?\Z")
_PLURAL = ("aban", "ían", "aron", "ieron")
_QUANTIFIER = {w: t for t, ws in reversed(es.QUANTIFIERS.items()) for w in ws}
#: Closed classes in the order of the tagger, the first that has a word wins.
_CLOSED: dict[str, str] = {}
for _pos, _words in (
    ("DET", es.ARTICLES), ("ADP", es.PREPOSITIONS), ("PRON", es.PRONOUNS), ("AUX", es.AUXILIARIES), ("CCONJ", es.CONJUNCTIONS), ("SCONJ", [k for k in es.SUBORDINATORS if " " not in k]),
    ("INTJ", es.INTERJECTIONS), ("ADV", es.NEGATORS), ("DET", _QUANTIFIER), ("ADV", [w for v in es.ADVERBS.values() for w in v if " " not in w]),
):
    for _w in _words:
        _CLOSED.setdefault(_w, _pos)


def tag(word: str) -> str:
    """Class of a word in small letters, as :func:`tesela.operators.grammar.rule_tokens` has it."""
    first = unicodedata.category(word[0])[0] if word else "P"
    if first not in "LN":
        return "PUNCT"
    if first == "N":
        return "NUM"
    if word in _CLOSED:
        return _CLOSED[word]
    return "ADV" if word.endswith("mente") else "VERB" if _VERB.search(word) else "ADJ" if _ADJ.search(word) else "NOUN"


class Units:
    """Tokens of a batch of units, flat: class, form, sentence and, once parsed, head and label of each.

    Places are those in the batch; a place that there is none of is -1.
    """

    def __init__(self, words: pa.ListArray) -> None:
        sizes = np.diff(words.offsets.to_numpy()) if len(words) else np.zeros(0, dtype=int)
        coded = words.flatten().dictionary_encode()
        self.vocabulary = coded.dictionary.to_pylist()
        self.code = coded.indices.to_numpy().astype(np.int64)
        self.n, self.sizes = len(self.code), sizes
        self.unit = np.repeat(np.arange(len(sizes)), sizes)
        self.at = np.arange(self.n)
        self.of_word = {w: k for k, w in enumerate(self.vocabulary)}
        self.pos = self.by_word(lambda w: _P[tag(w)], np.int8)
        self.punct = self.pos == _P["PUNCT"]
        ends = self.by_word(lambda w: w in (".", "?", "!", "…"), bool)
        new = np.ones(self.n, dtype=bool)
        new[1:] = ends[:-1] | (self.unit[1:] != self.unit[:-1])
        self.first, self.last = self.bounds(new)

    def by_word(self, of: Callable[[str], object], kind) -> np.ndarray:
        """A function of the word, at each token; made once for each word of the batch."""
        return np.array([of(w) for w in self.vocabulary], dtype=kind)[self.code]

    def listed(self, words) -> np.ndarray:
        known = set(words)
        return self.by_word(lambda w: w in known, bool)

    def bounds(self, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last place of the stretch of each token; ``new`` is where stretches begin."""
        starts = np.flatnonzero(new)
        which = np.cumsum(new) - 1
        return starts[which], (np.append(starts[1:], self.n) - 1)[which]

    def previous(self, mask: np.ndarray, itself: bool = False) -> np.ndarray:
        """The last place of the mask before each token, in its sentence."""
        found = np.maximum.accumulate(np.where(mask, self.at, -1))
        if not itself:
            found = np.concatenate([[-1], found[:-1]])
        return np.where(found >= self.first, found, -1)

    def following(self, mask: np.ndarray, itself: bool = False) -> np.ndarray:
        """The first place of the mask after each token, in its sentence."""
        found = np.minimum.accumulate(np.where(mask, self.at, self.n)[::-1])[::-1]
        if not itself:
            found = np.concatenate([found[1:], [self.n]])
        return np.where(found <= self.last, found, -1)

    def parse(self) -> Units:
        """Heads and labels of :func:`tesela.operators.grammar.shallow_parse`."""
        i, is_ = self.at, {p: self.pos == k for p, k in _P.items()}
        pv, nv, pn, nn = self.previous(is_["VERB"]), self.following(is_["VERB"]), self.previous(is_["NOUN"]), self.following(is_["NOUN"])
        pa_, ps = self.previous(is_["ADP"]), self.previous(is_["SCONJ"])
        verb, aux = self.following(is_["VERB"], True)[self.first], self.following(is_["AUX"], True)[self.first]
        self.root = root = np.where(verb >= 0, verb, np.where(aux >= 0, aux, self.first))
        self.infinite = ~(fin := self.by_word(lambda w: not (_INF.search(w) or _GER.search(w)), bool))
        self.finite = is_["VERB"] & fin
        near = np.where(pv < 0, nv, np.where(nv < 0, pv, np.where(i - pv <= nv - i, pv, nv)))
        adp, close = pa_ > np.maximum(pn, pv), (nn >= 0) & (nn - i <= 3)
        se, indirect, clitic = self.listed(["se"]), self.listed(["le", "les"]), self.listed(es.CLITIC_PRONOUNS)
        d = _D
        rules = [
            (i == root, i, d["root"]), (is_["PUNCT"], root, d["punct"]),
            (is_["DET"] & close, nn, d["det"]), (is_["NUM"] & close, nn, d["nummod"]), (is_["ADJ"] & close, nn, d["amod"]),
            (is_["ADJ"] & (pn >= 0), pn, d["amod"]), (is_["ADP"] & close, nn, d["case"]),
            (is_["NOUN"] & adp & (pn >= 0) & (pn > pv), pn, d["nmod"]), (is_["NOUN"] & adp & (near >= 0), near, d["obl"]),
            (is_["NOUN"] & (pv < 0) & (nv >= 0), nv, d["nsubj"]), (is_["NOUN"] & (pv >= 0), pv, d["obj"]),
            (is_["PRON"] & (near >= 0), np.where(nv >= 0, nv, pv), np.where(se, d["expl"], np.where(indirect, d["iobj"], np.where(clitic, d["obj"], d["nsubj"])))),
            (is_["AUX"] & (nv >= 0) & (nv - i <= 2), nv, d["aux"]), (is_["ADV"] & (near >= 0), near, d["advmod"]), (is_["SCONJ"] & (nv >= 0), nv, d["mark"]),
            (is_["CCONJ"], root, d["cc"]), (is_["INTJ"], root, d["discourse"]),
            (is_["VERB"], root, np.where(self.infinite & (i - pv <= 3), d["xcomp"], np.where(ps > pv, d["advcl"], d["conj"]))),
        ]
        self.head, self.dep = root.copy(), np.full(self.n, d["dep"])
        for where, head, label in reversed(rules):
            self.head, self.dep = np.where(where, head, self.head), np.where(where, label, self.dep)
        return self

    def children(self, mask: np.ndarray) -> np.ndarray:
        """How many children of each token fulfil a condition; roots are not their own children."""
        return np.bincount(self.head[mask & (self.head != self.at)], minlength=self.n)

    def verbs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(places of the verbs and auxiliaries, voice, whether a periphrasis)."""
        at = np.flatnonzero((self.pos == _P["VERB"]) | (self.pos == _P["AUX"]))
        subjects, se = self.children(self.dep == _D["nsubj"]), self.children(self.listed(["se"]) & (self.dep == _D["expl"]))
        clauses = self.children(((self.dep == _D["xcomp"]) | (self.dep == _D["advcl"])) & (self.pos == _P["VERB"]) & self.infinite)
        plural = self.by_word(lambda w: w.endswith(_PLURAL), bool)
        voice = np.where(se == 0, "Act", np.where(self.finite & (subjects > 0), "PASIVA_REFLEJA", np.where(self.finite & ~plural, "IMPERSONAL", "MEDIA")))
        return at, voice[at], (self.listed(es.PERIPHRASIS_VERBS) & (clauses > 0))[at]

    def negators(self) -> np.ndarray:
        return self.listed(es.NEGATORS)

    def negation_types(self) -> list[str]:
        """Type of each negation."""
        out, ni = [], self.listed(["ni"])
        for i in np.flatnonzero(self.negators()):
            up = self.head[i]
            scope, climbs = POS[self.pos[up]], POS[self.pos[up]] == "AUX"
            if climbs:
                scope = POS[self.pos[self.head[up]]]
            dep = DEP[self.dep[i]]
            if dep == "advmod":
                kind = "NEGACION_VERBAL" if scope in ("VERB", "AUX") else "NEGACION_DE_GRADO" if scope in ("ADJ", "ADV") else "NEGACION_ADVERBIAL"
            else:
                kind = "NEGACION_NOMINAL" if dep == "det" else "NEGACION_CONJUNTIVA" if dep == "cc" and ni[i] else "OTRA"
            out.append(kind + "_CONSTITUYENTE" * (scope in ("NOUN", "PRON", "ADJ", "ADV") and not climbs))
        return out

    def quantifier_types(self) -> Counter:
        """How often each type of quantifier occurs."""
        place = np.isin(self.pos, [_P[p] for p in ("DET", "PRON", "ADJ", "NUM")])
        words = np.bincount(self.code[place], minlength=len(self.vocabulary))
        out: Counter = Counter()
        for w, n in zip(self.vocabulary, words):
            if n and (kind := _QUANTIFIER.get(w) or ("NUMERAL_CARDINAL" if tag(w) == "NUM" else None)):
                out[kind] += int(n)
        return out

    def phrases(self, lexicon: dict[str, list[str]]) -> tuple[np.ndarray, list[str]]:
        """(places, categories) of the phrases of a lexicon between whatever marks, the longest at each place first."""
        at = np.flatnonzero(~self.punct)
        code, unit = self.code[at], self.unit[at]
        starts, lengths, names = [], [], []
        for name, listed in lexicon.items():
            for words in map(str.split, listed):
                codes = [self.of_word.get(w) for w in words]
                if None in codes:
                    continue
                j = np.flatnonzero(code == codes[0])
                j = j[j + len(codes) <= len(code)]
                for k, c in enumerate(codes[1:], 1):
                    j = j[(code[j + k] == c) & (unit[j + k] == unit[j])]
                starts.append(at[j]), lengths.append(np.full(len(j), len(codes))), names.extend([name] * len(j))
        if not names:
            return np.zeros(0, dtype=int), []
        start, length = np.concatenate(starts), np.concatenate(lengths)
        order = np.lexsort((-length, start))
        start, length = start[order], length[order]
        base = self.unit[start] * 100  # the phrases of one unit do not reach into the next
        ahead = np.concatenate([[-1], np.maximum.accumulate(base + start + length)[:-1]])
        kept = base + start >= ahead
        return start[kept], [names[k] for k in order[kept]]

    def markers(self) -> tuple[np.ndarray, list[str], np.ndarray]:
        """(places, categories, positions) of the discourse markers of :func:`tesela.operators.grammar.discourse_markers`."""
        opens, closes = np.ones(self.n, dtype=bool), np.ones(self.n, dtype=bool)
        same = self.unit[1:] == self.unit[:-1]
        opens[1:], closes[:-1] = ~same | self.punct[:-1], ~same | self.punct[1:]
        place = np.where(opens, 0, np.where(closes, 1, 2))
        at, names = self.phrases(es.LOCUTIONS)
        loose = np.flatnonzero(self.listed(es.CONNECTORS) & np.isin(self.pos, [_P[p] for p in ("CCONJ", "SCONJ", "INTJ", "ADV")]) & (place != 2))
        both = np.concatenate([at, loose])
        return both, names + ["CONECTORES"] * len(loose), place[both]


def with_words(texts: DataFrame, text: str, *keep: str) -> DataFrame:
    """(*keep, palabras): the tokens of each text in small letters."""
    return texts.select(*keep, F.transform(T.tokens(F.col(text)), lambda t: F.lower(t)).alias("palabras"))


def marker_counts(texts: DataFrame, unit: str, text: str) -> DataFrame:
    """(unit, palabras, marcadores): words and discourse markers of each unit that has words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u = Units(batch.column(1))
            words, marks = np.bincount(u.unit[~u.punct], minlength=len(batch)), np.bincount(u.unit[u.markers()[0]], minlength=len(batch))
            out = pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.int64()), pa.array(marks, pa.int64())], [unit, "palabras", "marcadores"])
            yield out.filter(pa.array(words > 0))

    return with_words(texts, text, unit).mapInArrow(run, f"`{unit}` {dict(texts.dtypes)[unit]}, palabras bigint, marcadores bigint")


def counted(texts: DataFrame, text: str, of: Callable[[Units], Counter], *names: str) -> DataFrame:
    """(*names, n): counts by tuples of strings, made in each batch and added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            total.update(of(Units(batch.column(0)).parse()))
        keys = list(total)
        yield pa.RecordBatch.from_arrays([*(pa.array([k[j] for k in keys], pa.string()) for j in range(len(names))), pa.array([total[k] for k in keys], pa.int64())], [*names, "n"])

    found = with_words(texts, text).mapInArrow(run, ", ".join(f"{n} string" for n in names) + ", n bigint")
    return found.groupBy(*names).agg(F.sum("n").alias("n"))


def summary(texts: DataFrame, text: str) -> DataFrame:
    """(familia, clave, valor, n): how often each value of each attribute of the annotations occurs."""

    def of(u: Units) -> Counter:
        out = Counter({("cuantificador", "tipo", k): n for k, n in u.quantifier_types().items()})
        _, voices, periphrases = u.verbs()
        _, names, places = u.markers()
        for family, key, values in (("negacion", "tipo", u.negation_types()), ("verbo", "voz", voices.tolist()), ("verbo", "perifrasis", np.where(periphrases, "true", "false").tolist()), ("marcador", "categoria", names), ("marcador", "posicion", [PLACES[k] for k in places])):
            out.update({(family, key, v): n for v, n in Counter(values).items()})
        return out

    return counted(texts, text, of, "familia", "clave", "valor")


def negated_verbs(texts: DataFrame, text: str, reach: int = 5) -> DataFrame:
    """(pos, negacion, n): verbs and auxiliaries, and whether a negation of their sentence is ``reach`` tokens or fewer before."""

    def of(u: Units) -> Counter:
        at, last = u.verbs()[0], u.previous(u.negators(), True)
        near = (last[at] >= 0) & (at - last[at] <= reach)
        return Counter(zip((POS[k] for k in u.pos[at]), np.where(near, "true", "false").tolist()))

    return counted(texts, text, of, "pos", "negacion").withColumn("negacion", F.col("negacion") == "true")
