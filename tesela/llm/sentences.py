"""Problem 6: sentence boundaries across languages and scripts.

Marks that may end a sentence are the candidates. Each is described by the mark, the token before it (its
kind, length, case and, if frequent, itself), what follows (its kind and, if frequent, the word), the gap
between and the scripts on both sides, and a maximum-entropy model over these features and their conjunctions
decides. It is trained on reliable boundaries: candidates of a bounded sample, and of a few sentences in other
languages, whose description leaves no doubt. Which short words are abbreviations is counted over all texts.
"""

from __future__ import annotations

import re
import sys
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Texts of the training sample, at most, and their greatest length: both bound what the driver holds.
SAMPLE_LENGTH = 20_000
SAMPLE_TEXTS = 3000
#: Words before and after a candidate that are features of their own, at most: the most frequent of the sample.
FREQUENT_WORDS = 120
#: An abbreviation has its full stop in so many of its uses, and so many uses: at least the first number, and that share of all dotted short words.
DOTTED_SHARE, DOTTED_LEAST = 0.8, (4, 1e-5)
#: An ordinary short word has a full stop inside a sentence in fewer of its uses than this, and as many uses as the rest tells.
PLAIN_SHARE, PLAIN_LEAST = 0.3, (3, 1e-7)

# Abbreviations. Those that always have something after them, and those that may be a sentence's last word.
LEADING = frozenset(
    "dr dra dres sr sra srta sres sras d dª dña lic ing arq prof profa mr mrs ms st mme mlle hr hrn fr herr frau κ κα ул пл пр им"
    " av avda avd ctra pza pl c cl ud uds vd vds art arts cap caps fig figs pág págs pag pags núm num n nº no nr vol vols ref refs"
    " cf p pp s ss ca vgl bzw ed eds trad vs tel tlf ej ex exa expte vid véase p.ej p.ex z.b u.a d.h т.е т.к см стр рис гл sta sto gral gen col cap"
    " e.g i.e π.χ ee ff jj dd rr oo cc sen gov rep lt sgt capt cpt maj cmdr rev hon pres supt mt ft messrs bros"
    " mons mgr pbro fdo rte dirs abg lcdo mtro mtra".split()
)
ENDING = frozenset("etc aprox izda dcha izq dpto urb entlo pral uu ee.uu ss.aa cía cia ltda inc ltd co corp jr ph.d м.б др т.д т.п usw a.m p.m κλπ κ.λπ a.c d.c".split())
#: Of these, those after which a sentence hardly ever goes on but with one of the words given next.
CLOSING = frozenset("etc aprox usw κλπ".split())
GOING_ON = frozenset("y e o u ni de del en que con para por a al se es son está fue und oder and or i".split())
MONTHS = frozenset(
    "januar februar märz april mai juni juli august september oktober november dezember"
    " january february march may june july october december"
    " января февраля марта апреля мая июня июля августа сентября октября ноября декабря".split()
)
TOP_DOMAINS = frozenset("example test invalid localhost com org net edu gov es mx cl ar fr de pt it eu info io cat".split())

#: Every sentence-final mark of Unicode, the ellipsis and the Greek question mark.
_FINAL = "".join(sorted({*regex.findall(r"\p{Sentence_Terminal}", "".join(map(chr, [*range(0xD800), *range(0xE000, sys.maxunicode + 1)]))), *"….;\u037e"}))
_MARK = re.escape(_FINAL)
_LINE = "\n\r\x0b\x0c\x85\u2028\u2029"
_CANDIDATE = re.compile(f"[{_MARK}]+|[{_LINE}]")
_CANDIDATE_THAI = re.compile(f"[{_MARK}]+|[{_LINE}]|(?<=[ก-๛])[^\\S{_LINE}]+(?=\\S)")
_THAI = re.compile("[ก-๛]")
_QUOTES = re.compile(f"[«»“”„‟‘「」『』\"()\\[\\]{_LINE}]")
_HAS_QUOTE = re.compile("[«»“”„「」『』\"()\\[\\]]")
_PAIRS = {"»": "«", "”": "“„", "」": "「", "』": "『", ")": "(", "]": "["}
_CLOSERS = frozenset("»”’\"')]」』›")
_OPENERS = frozenset("¿¡«“„‘「『\"'([‹")
_DASHES = frozenset("—–-―‒")
_STOPS = frozenset(",;:)]}»”%/，、；：،؛")
_QUOTE_OR_LINE = re.compile(f'["{_LINE}]')
_NEXT_WORD = re.compile(r"\w+")
_RIGHT = re.compile(r"[\w@.\-]*")
_NUMBER = re.compile(r"[\d.,/:\-+()]*\d[\d.,/:\-+()]*")
_LOOKS_CJK = re.compile("[⺀-鿿豈-﫿぀-ヿ]")


def _spans(text: str) -> tuple[list[tuple[int, int]], set[int]]:
    """Quotations and asides whose inner marks end nothing, and the places of closing quotes."""
    stack: list[tuple[str, int]] = []
    found: list[tuple[int, int]] = []
    closing: set[int] = set()
    first_line = True
    for m in _QUOTES.finditer(text):
        c, i = m.group(), m.start()
        if c in _LINE:
            found += [(o, i) for _, o in stack if _embedded(text, o)]
            stack.clear()
            first_line = False
            continue
        if c == '"':
            opened = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == '"'), None)
            if opened is None:
                mate = _QUOTE_OR_LINE.search(text, i + 1)
                if mate and mate.group() == '"':
                    stack.append((c, i))
                continue
            wanted = '"'
        elif c == "“" and stack and stack[-1][0] == "„":
            wanted = "„"
        elif c in _PAIRS:
            wanted = _PAIRS[c]
        else:
            stack.append((c, i))
            continue
        at = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] in wanted), None)
        closing.add(i)
        if at is None:
            if first_line and _continues(text, i + 1):
                found.append((-1, i))
            continue
        o = stack[at][1]
        del stack[at:]
        if c in ")]" or _embedded(text, o) or _continues(text, i + 1):
            found.append((o, i))
    found += [(o, len(text)) for q, o in stack if q not in '("[' and _embedded(text, o)]
    return sorted(found), closing


def _embedded(text: str, at: int) -> bool:
    """Whether a quotation that opens at ``at`` stands inside a sentence."""
    i = at - 1
    while i >= 0 and text[i] not in _LINE and (text[i].isspace() or text[i] in _DASHES or text[i] in "¿¡"):
        i -= 1
    if i < 0 or text[i] in _LINE:
        return False
    return text[i] not in _FINAL and not (text[i] in _CLOSERS and i and text[i - 1] in _FINAL)


def _continues(text: str, at: int) -> bool:
    """Whether the sentence goes on after a quotation that closed just before ``at``."""
    i, n = at, len(text)
    while i < n and text[i].isspace():
        if text[i] in _LINE:
            return False
        i += 1
    if i >= n:
        return False
    c = text[i]
    if c in _DASHES:
        i += 1
        while i < n and text[i].isspace():
            i += 1
        return i < n and text[i].islower()
    if c.islower() or c in ",;:，、；：،؛":
        return True
    return i == at and c.isalpha() and not c.isupper()


#: Scripts told apart, by the last code point of each.
_SCRIPTS = ((0x24F, "latin"), (0x36F, ""), (0x3FF, "greek"), (0x52F, "cyrillic"), (0x58F, "armenian"), (0x5FF, "hebrew"), (0x8FF, "arabic"), (0xDFF, "indic"), (0xEFF, "thai"), (0x1EFF, "other"), (0x1FFF, "greek"), (0x2E7F, ""), (0xD7FF, "ideographs"))


@lru_cache(maxsize=65_536)
def _script(c: str) -> str:
    code = ord(c) if c else 0
    if not c.isalpha():
        return "digit" if c.isdigit() else ""
    return next((name for last, name in _SCRIPTS if code <= last), "other")


class Model:
    """Weights of the maximum-entropy model, and the abbreviations and ordinary short words it knows."""

    def __init__(self, weights: dict[str, float], learned: frozenset[str], words: frozenset[str] = frozenset()) -> None:
        self.weights, self.learned, self.words = weights, learned, words
        self.known: dict[tuple, bool] = {}
        self.frequent = frozenset(f[2:] for f in weights if f[:2] in ("w=", "n="))

    def ends(self, description: tuple) -> bool:
        """Whether a candidate ends its sentence."""
        *rest, word, following = description
        key = (*rest, word if word in self.frequent else "", following if following in self.frequent else "")
        found = self.known.get(key)
        if found is None:
            found = self.known[key] = sum(self.weights.get(f, 0.0) for f in _features(key)) > 0
        return found

    def starts(self, text: str | None) -> list[int]:
        """Where the sentences of a text begin: none for a null or blank text."""
        if not text:
            return []
        n = len(text)
        at = 0
        while at < n and text[at].isspace():
            at += 1
        if at == n:
            return []
        out = [at]
        spans, closing = _spans(text) if _HAS_QUOTE.search(text) else ((), ())
        pattern = _CANDIDATE_THAI if _THAI.search(text) else _CANDIDATE
        reach, furthest = 0, -1  # spans that open before the candidate, and where the last of them closes
        blank = -1  # the last blank before the candidate
        for m in pattern.finditer(text):
            i = m.start()
            if i < out[-1]:
                continue
            c = text[i]
            k = m.end()
            if c in _LINE or c.isspace():
                if c not in _LINE and _inside(spans, i, k):
                    continue
            else:
                while k < n and (text[k] in _CLOSERS and text[k] != '"' or k in closing):
                    k += 1
                if k + 1 < n and text[k + 1] == "»" and text[k] in " \xa0\u202f" and k + 1 in closing:
                    k += 2
                while reach < len(spans) and spans[reach][0] < i:
                    furthest = max(furthest, spans[reach][1])
                    reach += 1
                if k <= furthest:
                    continue
                if c == ".":
                    blank = max(blank, text.rfind(" ", blank + 1, i))
                description = self.describe(text, i, m.end(), k, blank)
                if description is None or not self.ends(description):
                    continue
            while k < n and text[k].isspace():
                k += 1
            if k < n and k > out[-1]:
                out.append(k)
        return out

    def describe(self, text: str, i: int, end: int, k: int, blank: int | None = None) -> tuple | None:
        """The candidate text[i:end], closed by k; None: surely no end.

        (mark, kind of token before, kind of what follows, gap, length and case of the token, scripts before and after,
        the token, the word that follows). ``blank`` is the last blank before a full stop, if it is known.
        """
        n = len(text)
        q = k
        while q < n and text[q].isspace():
            q += 1
        gap = "no" if q == k else "blank"
        c = text[end - 1]
        if end - i > 1:
            c = next((x for x in text[i:end] if x in "!?。！？؟।"), "…" if "." in text[i:end] or "…" in text[i:end] else c)
        left = ""
        if c == "." or c == ";":
            j = text.rfind(" ", 0, i) if blank is None or c == ";" else blank
            left = text[j + 1 : i]
            if not left.isalnum():
                left = left.split()[-1] if left and not left[-1:].isspace() and left.split() else ""
                left = left.lstrip("¿¡«“„\"'([{—–-「『‘")
        if c == ";" and not (left and "Ͱ" <= left[-1] <= "Ͽ" or left and "ἀ" <= left[-1] <= "῿"):
            return None
        mark = "." if c == "." else "…" if c == "…" else "!" if c in "!?" else "。"
        # what follows
        if q >= n or text[q] in _LINE or any(x in _LINE for x in text[k:q]):
            after = "end"
        else:
            x = text[q]
            if x in _DASHES:
                r = q + 1
                while r < n and text[r].isspace():
                    r += 1
                after = "stop" if r < n and text[r].islower() else "dash"
            elif x.isupper():
                after = "upper"
            elif x.islower():
                after = "stop" if k > end else "lower"
            elif x in _STOPS:
                after = "stop"
            elif x in _OPENERS:
                after = "open"
            elif x.isdigit():
                after = "digit"
            elif x in "ºª°":
                return None
            elif x.isalpha():
                after = "stop" if k > end and gap == "no" else "caseless"
            else:
                after = "other"
        following = _NEXT_WORD.match(text, q)
        sides = _script(text[i - 1 : i]), _script(text[q : q + 1])
        word = following.group().lower() if following else ""
        if mark != ".":
            return mark, "", after, gap, "", "", *sides, "", word
        if gap == "no" and after in ("lower", "upper", "digit", "caseless") and k == end:
            if after == "lower":
                return None  # an address, or an abbreviation written without blanks
            right = _RIGHT.match(text, end, end + 60).group().rstrip(".-")
            if "@" in left or "@" in right or left.lower() == "www" or left.lower().startswith("www.") or right.rpartition(".")[2].lower() in TOP_DOMAINS or "://" in left:
                return None
            if left[-1:].isdigit() and after == "digit":
                return None
            if len(left) <= 2 and (after != "upper" or left.isupper()) or left.isupper() and right.isupper():
                return None
        size = "1" if len(left) < 2 else "2" if len(left) < 3 else "3" if len(left) < 4 else "5" if len(left) < 6 else "6"
        case = "lower" if left.islower() else "upper" if left.isupper() else "title" if left[:1].isupper() else ""
        return mark, self.token(text, i, left, after, q), after, gap, size, case, *sides, left.lower(), word

    def token(self, text: str, i: int, left: str, after: str, q: int) -> str:
        """Kind of the token before a full stop."""
        if not left:
            return "none"
        low = left.lower()
        if left[-1].isdigit():
            if _NUMBER.fullmatch(left) and len(left) <= 2:
                word = re.match(r"\w*", text[q : q + 12]).group().lower()
                if word in MONTHS:
                    return "ordinal"
                before = text[max(0, i - len(left) - 3) : i - len(left)]
                return "item" if not before.strip() and (i - len(left) <= 1 or "\n" in before) else "number"
            return "number"
        if "@" in left:
            return "word"
        if len(left) == 1:
            before = text[max(0, i - 14) : i - 1].split()
            before = before[-1] if before and text[i - 2 : i - 1].isspace() else ""
            if low == "m" and before.lower() in ("a.", "p."):
                return "ending"
            if left.isupper():
                return "numbered" if before[-1:].isdigit() or before[-1:] in ("º", "ª") else "initial"
            if not left.isalpha() or not left.islower():
                return "word"  # a syllable or ideogram, a sign
            return "leading"
        if low in CLOSING and after == "lower" and re.match(r"\w*", text[q : q + 12]).group() not in GOING_ON:
            return "word"
        if low in ENDING:
            return "ending"
        if low in LEADING:
            return "leading"
        if "." in left:
            tail = low.rpartition(".")[2]
            if len(left) <= 6 and len(tail) <= 1:
                return "numbered" if left[0].isdigit() else "dotted"
            low = left = tail  # no blank after the sentence before
            if low in ENDING or low in LEADING:
                return "ending" if low in ENDING else "leading"
        if low in self.learned:
            return "learned"
        return "word" if len(left) > 3 or low in self.words else "short"


def _inside(spans, i: int, k: int) -> bool:
    return any(o < i and k <= e for o, e in spans)


def _features(description: tuple) -> list[str]:
    mark, token, after, gap, size, case, before, behind, word, following = description
    out = ["", f"m{mark}", f"t{token}", f"a{after}", f"g{gap}", f"{mark}|{after}", f"{token}|{after}", f"{mark}|{gap}", f"{after}|{gap}", f"{mark}|{after}|{gap}", f"{mark}|{token}|{after}"]
    out += [f"l{size}", f"c{case}", f"l{size}|{case}|{after}", f"s{before}", f"r{behind}", f"{before}|{behind}"]
    if word:
        out.append(f"w={word}")
    if following:
        out.append(f"n={following}")
    return out


def reliable(key: tuple) -> bool | None:
    """True or False where mark, token, what follows and gap leave no doubt, else None."""
    mark, token, after, gap = key[:4]
    if after == "stop":
        return False
    if mark == "…":
        return False if after == "lower" else True if after in ("upper", "open", "end", "caseless", "dash") else None
    if mark == "!":
        return True if after in ("upper", "open", "end", "caseless", "dash") or after in ("lower", "digit") and gap == "blank" else None
    if mark == "。":
        return True if after in ("upper", "open", "end", "caseless", "dash", "digit") else None
    if token in ("leading", "initial", "ordinal", "item", "dotted"):
        return after == "end" if after in ("upper", "lower", "digit", "open", "end", "caseless") else None
    if token in ("ending", "learned"):
        return after in ("upper", "open", "end", "dash", "caseless") if after != "other" else None
    if token in ("word", "number", "numbered"):
        if gap == "no":
            return True if after in ("upper", "open", "end", "caseless") else None
        return True if after in ("upper", "open", "end", "lower", "caseless", "dash", "digit") else None
    if token == "short":
        return True if after in ("upper", "open", "end") else None
    return None


# Sentences that every model is trained on besides its sample, so that no script is without an example.
SEED = (
    "The hall was empty. Mrs. Hale, i.e. the owner, wrote at 9.15 to Dr. Moss. \"Who is it?\" Nobody knew... She was... well, late. She paid 3.50 for pp. 12 to 14. Really?! Yes! Hill & Co. in Kent, owned by Hill Jr. since May, sold it at 7 p.m. or so. At last it rained.",
    "La puerta se cerró. ¿Quién era? ¡Nadie! El Sr. Luna, núm. 4, pagó 3.500 y se fue... Pues sí... eso creo. Compró pan, sal, etc. Luego durmió. Vive en EE. UU. desde 1998. La cía. de su tío daba pan, sal, etc. al pueblo. Vino J. Luna a las 10.30. no sé. ¿Y tú?",
    "Il pleuvait. Où est-elle ? Personne ! M. Petit, p. ex., attendait le 3.5.1998. « Viens ! » dit-il. Elle partit... Puis... rien.",
    "A chuva parou. O Dr. Lima saiu, pág. 9. Quem viu? Ninguém! Era tarde... Depois dormiu.",
    "Es regnete. Am 3. Mai kam Hr. Berg, z. B. mit Brot, Nr. 7. Wer war es? Niemand! Er schwieg... Dann… ging er. Das kostet 4.500 usw. Danach schlief er.",
    "Va ploure. El Sr. Puig, pàg. 3, dormia. Qui era? Ningú! Després res.",
    "Έβρεχε. Ο κ. Ρήγας, π.χ. το βράδυ, ήρθε; Κανείς! Μετά τίποτα. Πλήρωσε 3,50.",
    "Шёл дождь. На ул. Мира, т. е. дома, было тихо. Кто там? Никто! Потом... уснули... В 9.15 пришли. Всё.",
    "बारिश हुई। कौन था? कोई नहीं! फिर सब सो गए।",
    "توقف المطر. من هناك؟ لا أحد! ثم ناموا۔",
    "雨停了。谁在那里？没有人！“走吧。”他说。后来睡了。",
    "雨がやんだ。誰ですか？誰もいない！「行こう。」と言った。それから寝た。",
    "ភ្លៀងឈប់។ គ្មាននរណាទេ។",
    "မိုးတိတ်သည်။ ဘယ်သူမှမရှိ။",
)
_DOTTED = re.compile(r"(?<![\w.@])([^\W\d_]{2,5})\.(?=,|\s+[a-zà-öø-ÿα-ωά-ώа-яё0-9])")
_SHORT = re.compile(r"(?<![\w.@])[^\W\d_]{2,5}(?![\w@])")


def _counted(texts: Iterable[str | None]) -> tuple[Counter, Counter]:
    """Uses of short words before a full stop inside a sentence, and all their uses."""
    dotted, plain = Counter(), Counter()
    for t in texts:
        if t:
            dotted.update(w.lower() for w in _DOTTED.findall(t))
            plain.update(w.lower() for w in _SHORT.findall(t))
    return dotted, plain


def _short_words(rows: Iterable[tuple[str, int, int]], n_dotted: int, n_plain: int) -> tuple[frozenset[str], frozenset[str]]:
    """(abbreviations, ordinary words) of (word, dotted uses, uses)."""
    learned, words = set(), set()
    for w, dotted, uses in rows:
        if dotted >= max(DOTTED_LEAST[0], DOTTED_LEAST[1] * n_dotted) and dotted >= DOTTED_SHARE * uses:
            learned.add(w)
        elif len(w) <= 3 and uses >= max(PLAIN_LEAST[0], PLAIN_LEAST[1] * n_plain) and dotted < PLAIN_SHARE * uses:
            words.add(w)
    return frozenset(learned), frozenset(words)


def short_words(texts: DataFrame) -> tuple[frozenset[str], frozenset[str]]:
    """Abbreviations and ordinary short words, counted over all of (…, texto).

    Batches count their words, the counts are added by word, and only words over the shares of DOTTED_LEAST
    and PLAIN_LEAST, at most as many as these allow, come to the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dotted, plain = _counted(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(plain), pa.string()), pa.array([dotted[w] for w in plain], pa.int64()), pa.array(list(plain.values()), pa.int64())], ["palabra", "con_punto", "usos"]
            )

    counts = texts.select("texto").mapInArrow(run, "palabra string, con_punto long, usos long").groupBy("palabra").agg(F.sum("con_punto").alias("con_punto"), F.sum("usos").alias("usos")).checkpoint()
    totals = counts.agg(F.coalesce(F.sum("con_punto"), F.lit(0)).alias("d"), F.coalesce(F.sum("usos"), F.lit(0)).alias("u")).first()
    dotted = (F.col("con_punto") >= max(DOTTED_LEAST[0], DOTTED_LEAST[1] * totals["d"])) & (F.col("con_punto") >= DOTTED_SHARE * F.col("usos"))
    plain = (F.length("palabra") <= 3) & (F.col("usos") >= max(PLAIN_LEAST[0], PLAIN_LEAST[1] * totals["u"]))
    return _short_words(map(tuple, counts.where(dotted | plain).collect()), totals["d"], totals["u"])


def train(texts: Iterable[str | None], known: tuple[frozenset[str], frozenset[str]] | None = None, l2: float = 0.1, steps: int = 60) -> Model:
    """A model from the reliable candidates of ``texts`` and of SEED.

    ``known`` are the abbreviations and ordinary short words, from :func:`short_words`; without it they are
    counted in ``texts``. The most frequent words beside the candidates become features of their own.
    """
    texts = [t for t in texts if t]
    if known is None:
        dotted, plain = _counted(texts)
        known = _short_words(((w, dotted[w], k) for w, k in plain.items()), sum(dotted.values()), sum(plain.values()))
    model = Model({}, *known)
    counts: Counter = Counter()
    for t in (*SEED, *texts):
        _, closing = _spans(t) if _HAS_QUOTE.search(t) else ((), ())
        for m in _CANDIDATE.finditer(t):
            if t[m.start()] in _LINE:
                continue
            k = m.end()
            while k < len(t) and (t[k] in _CLOSERS and t[k] != '"' or k in closing):
                k += 1
            found = model.describe(t, m.start(), m.end(), k)
            if found is not None and reliable(found) is not None:
                counts[found] += 1
    beside: tuple[Counter, Counter] = Counter(), Counter()
    for d, c in counts.items():
        beside[0][d[-2]] += c
        beside[1][d[-1]] += c
    common = [{w for w, _ in b.most_common(FREQUENT_WORDS)} for b in beside]
    merged: Counter = Counter()
    for d, c in counts.items():
        merged[(*d[:-2], *(w if w in own else "" for w, own in zip(d[-2:], common)))] += c
    index: dict[str, int] = defaultdict(lambda: len(index))
    columns = [[index[f] for f in _features(d)] for d in merged]
    x = np.zeros((len(columns), len(index)))
    for row, cols in zip(x, columns):
        row[cols] = 1
    y = np.array([float(reliable(d)) for d in merged])
    w = np.log1p(np.array(list(merged.values()), dtype=float))
    beta = np.zeros(x.shape[1])
    for _ in range(steps):  # Newton's method
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (w * (y - p)) - l2 * beta
        hessian = (x.T * (w * p * (1 - p))) @ x + l2 * np.eye(len(beta))
        move = np.linalg.solve(hessian, gradient)
        beta += move
        if np.abs(move).max() < 1e-6:
            break
    return Model({f: float(beta[i]) for f, i in index.items()}, *known)


def train_on(df: DataFrame, key: str, text: str, known: tuple[frozenset[str], frozenset[str]] | None = None, sample: int = SAMPLE_TEXTS) -> Model:
    """A model from at most ``sample`` texts of the table, none longer than SAMPLE_LENGTH characters.

    They are drawn by a hash of the key, so that the order and the files of the table do not matter.
    """
    part = max(1, df.count() // sample)
    drawn = F.xxhash64(df[key].cast("string"))
    rows = df.where((F.char_length(text) <= SAMPLE_LENGTH) & (F.pmod(drawn, F.lit(part)) == 0)).select(drawn.alias("_h"), text).orderBy("_h").limit(sample).collect()
    return train((r[1] for r in rows), known)


def sentence_starts(texts: DataFrame, model: Model, keep: tuple[str, ...] = ("tabla", "clave")) -> DataFrame:
    """Columns ``keep`` and ``inicios`` (code points from 0) of (…, texto), without an exchange."""
    learned = (model.weights, model.learned, model.words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*learned)
        for batch in batches:
            found = pa.array([own.starts(t) for t in batch.column("texto").to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), found], [*keep, "inicios"])

    kinds = dict(texts.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "inicios array<int>"])
    return texts.select(*keep, "texto").mapInArrow(run, schema)


def split_sentences(texts: DataFrame, model: Model, keep: tuple[str, ...] = ("tabla", "clave")) -> DataFrame:
    """Columns ``keep``, orden, inicio and oracion (without white space at its end), one row per sentence."""
    learned = (model.weights, model.learned, model.words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*learned)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                rows, order, starts, sentences = [], [], [], []
                for row, text in enumerate(part.column("texto").to_pylist()):
                    found = own.starts(text)
                    for i, (a, b) in enumerate(zip(found, [*found[1:], None])):
                        rows.append(row)
                        order.append(i)
                        starts.append(a)
                        sentences.append(text[a:b].rstrip())
                taken = part.take(pa.array(rows, pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [*(taken.column(c) for c in keep), pa.array(order, pa.int32()), pa.array(starts, pa.int32()), pa.array(sentences, pa.string())],
                    [*keep, "orden", "inicio", "oracion"],
                )

    kinds = dict(texts.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "orden int, inicio int, oracion string"])
    return texts.select(*keep, "texto").mapInArrow(run, schema)
