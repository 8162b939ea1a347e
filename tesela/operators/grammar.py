"""Rules over a token table: negation, pronouns, verbs, quantifiers, adverbs, markers, insubordination, complexity.

A token row is (doc_id, uce_id, sent_id, i, text, lower, lemma, pos, dep, head_i, morph map, char_start,
char_end, is_stop, is_punct, is_alpha); head_i is the place of the head in the same sentence, its own for a
root. Rules are joins of a token with its head and with counts over its children; sentences are the key, so
each rule shuffles by sentence once. Offsets are those of the tokens.
"""

from __future__ import annotations

from itertools import chain

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesela.functions import text as T
from tesela.operators import lexicon_es as es

SENTENCE = ["doc_id", "uce_id", "sent_id"]


def _in(column: Column, words) -> Column:
    return column.isin(list(words))


def rule_tokens(texts: DataFrame, doc: str, unit: str, text: str) -> DataFrame:
    """Tokens by the built-in tagger: closed classes, then endings; no heads (every token is its own).

    Each mark of end of sentence starts a new sentence. For dependencies give a table from a parser instead.
    """
    listed = texts.select(F.col(doc).alias("doc_id"), F.col(unit).alias("uce_id"), F.posexplode(T.tokens(F.col(text))).alias("i", "text"))
    low = F.lower("text")
    window = Window.partitionBy("doc_id", "uce_id").orderBy("i")
    sentence = F.coalesce(F.sum(F.col("text").isin(".", "?", "!", "…").cast("int")).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    alpha, punct = F.col("text").rlike("^\\p{L}"), ~F.col("text").rlike("^[\\p{L}\\p{N}]")
    pos = (
        F.when(punct, "PUNCT").when(F.col("text").rlike("^\\p{N}"), "NUM").when(_in(low, es.ARTICLES), "DET").when(_in(low, es.PREPOSITIONS), "ADP")
        .when(_in(low, es.PRONOUNS), "PRON").when(_in(low, es.AUXILIARIES), "AUX").when(_in(low, es.CONJUNCTIONS), "CCONJ")
        .when(_in(low, [k for k in es.SUBORDINATORS if " " not in k]), "SCONJ").when(_in(low, es.INTERJECTIONS), "INTJ").when(_in(low, es.NEGATORS), "ADV")
        .when(_in(low, [w for v in es.QUANTIFIERS.values() for w in v]), "DET")
        .when(_in(low, {w for v in es.ADVERBS.values() for w in v if " " not in w}) | low.rlike("mente$"), "ADV")
        .when(low.rlike("(?:ar|er|ir|ando|iendo|aba|aban|ía|ían|ó|aron|ieron)(?:me|te|se|lo|la|los|las|le|les|nos)?$"), "VERB")
        .when(low.rlike("(?:oso|osa|able|ible|ico|ica|al|ivo|iva)s?$"), "ADJ").otherwise("NOUN")
    )
    form = F.when(low.rlike("(?:ar|er|ir)(?:me|te|se|lo|la|los|las|le|les|nos)?$"), "Inf").when(low.rlike("(?:ando|iendo)(?:me|te|se|lo|la|los|las|le|les|nos)?$"), "Ger").otherwise("Fin")
    tagged = listed.select("*", low.alias("lower"), low.alias("lemma"), pos.alias("pos"), sentence.cast("int").alias("sent_id"), alpha.alias("is_alpha"), punct.alias("is_punct"))
    return tagged.select(
        "doc_id", "uce_id", "sent_id", "i", "text", "lower", "lemma", "pos", F.lit("dep").alias("dep"), F.col("i").alias("head_i"),
        F.when(F.col("pos") == "VERB", F.create_map(F.lit("VerbForm"), form)).otherwise(F.create_map().cast("map<string,string>")).alias("morph"),
        F.lit(None).cast("int").alias("char_start"), F.lit(None).cast("int").alias("char_end"),
        F.col("pos").isin("DET", "ADP", "PRON", "AUX", "CCONJ", "SCONJ").alias("is_stop"), "is_punct", "is_alpha",
    )


def shallow_parse(tokens: DataFrame) -> DataFrame:
    """Heads, labels and morphology by position, for tokens of :func:`rule_tokens`.

    A sentence's root is its first verb, else its first auxiliary, else its first token. Determiners, numerals,
    adjectives and prepositions hang on a noun near them, nouns on the noun or verb before them (after a
    preposition: nmod, obl; else the subject of the verb that follows or the object of the one before), clitics
    and auxiliaries on the verb that follows, adverbs on the nearest verb, further verbs on the root. Endings give
    person, number and tense of finite verbs. Two windows over a sentence, which the tokens are parted by already.
    """
    order = Window.partitionBy(*SENTENCE).orderBy("i")
    before, after, whole = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing), Window.partitionBy(*SENTENCE)
    is_ = lambda *pos: F.when(F.col("pos").isin(*pos), F.col("i"))
    t = tokens.select(
        "*", F.last(is_("VERB"), True).over(before).alias("_pv"), F.first(is_("VERB"), True).over(after).alias("_nv"), F.last(is_("NOUN"), True).over(before).alias("_pn"),
        F.first(is_("NOUN"), True).over(after).alias("_nn"), F.last(is_("ADP"), True).over(before).alias("_pa"), F.last(is_("SCONJ"), True).over(before).alias("_ps"),
        F.coalesce(F.min(is_("VERB")).over(whole), F.min(is_("AUX")).over(whole), F.min("i").over(whole)).alias("_root"),
    )
    pv, nv, pn, nn, root, i, pos, low = (F.col(c) for c in ("_pv", "_nv", "_pn", "_nn", "_root", "i", "pos", "lower"))
    near = F.when(pv.isNull(), nv).when(nv.isNull(), pv).when(i - pv <= nv - i, pv).otherwise(nv)
    with_adp = F.coalesce(F.col("_pa"), F.lit(-1)) > F.greatest(F.coalesce(pn, F.lit(-1)), F.coalesce(pv, F.lit(-1)))
    after_noun = pn.isNotNull() & (pn > F.coalesce(pv, F.lit(-1)))
    close_noun = nn.isNotNull() & (nn - i <= 3)
    form = morph("VerbForm")
    to = lambda head, label: F.struct(head.alias("h"), label.alias("d"))
    link = (
        F.when(i == root, to(i, F.lit("root"))).when(pos == "PUNCT", to(root, F.lit("punct")))
        .when(pos.isin("DET", "NUM", "ADJ") & close_noun, to(nn, F.when(pos == "DET", "det").when(pos == "NUM", "nummod").otherwise("amod")))
        .when((pos == "ADJ") & pn.isNotNull(), to(pn, F.lit("amod"))).when((pos == "ADP") & close_noun, to(nn, F.lit("case")))
        .when((pos == "NOUN") & with_adp & after_noun, to(pn, F.lit("nmod"))).when((pos == "NOUN") & with_adp & near.isNotNull(), to(near, F.lit("obl")))
        .when((pos == "NOUN") & pv.isNull() & nv.isNotNull(), to(nv, F.lit("nsubj"))).when((pos == "NOUN") & pv.isNotNull(), to(pv, F.lit("obj")))
        .when((pos == "PRON") & near.isNotNull(), to(F.coalesce(nv, pv), F.when(low == "se", "expl").when(low.isin("le", "les"), "iobj").when(low.isin(es.CLITIC_PRONOUNS), "obj").otherwise("nsubj")))
        .when((pos == "AUX") & nv.isNotNull() & (nv - i <= 2), to(nv, F.lit("aux"))).when((pos == "ADV") & near.isNotNull(), to(near, F.lit("advmod")))
        .when((pos == "SCONJ") & nv.isNotNull(), to(nv, F.lit("mark"))).when(pos == "CCONJ", to(root, F.lit("cc"))).when(pos == "INTJ", to(root, F.lit("discourse")))
        .when(pos == "VERB", to(root, F.when(form.isin("Inf", "Ger") & (i - pv <= 3), "xcomp").when(F.coalesce(F.col("_ps"), F.lit(-1)) > pv, "advcl").otherwise("conj")))
        .otherwise(to(root, F.lit("dep")))
    )
    plural, past = low.rlike("(?:aban|ían|aron|ieron)$"), low.rlike("(?:ó|aron|ieron)$")
    finite = F.map_concat("morph", F.create_map(F.lit("Person"), F.lit("3"), F.lit("Number"), F.when(plural, "Plur").otherwise("Sing"), F.lit("Tense"), F.when(past, "Past").otherwise("Imp"), F.lit("Mood"), F.lit("Ind")))
    pronoun = F.when(low.isin(es.REFLEXIVES), F.create_map(F.lit("PronType"), F.lit("Prs"), F.lit("Reflex"), F.lit("Yes"))).otherwise(F.create_map(F.lit("PronType"), F.lit("Prs")))
    shaped = F.when((pos == "VERB") & (form == "Fin"), finite).when(pos == "PRON", pronoun).otherwise(F.col("morph"))
    linked = t.withColumn("_l", link)
    return linked.select(*(F.col("_l.h").alias(c) if c == "head_i" else F.col("_l.d").alias(c) if c == "dep" else shaped.alias(c) if c == "morph" else F.col(c) for c in tokens.columns))


def with_head(tokens: DataFrame, *columns: str) -> DataFrame:
    """Adds h_<column> of each token's head."""
    head = tokens.select(*SENTENCE, F.col("i").alias("head_i"), *(F.col(c).alias(f"h_{c}") for c in columns))
    return tokens.join(head, [*SENTENCE, "head_i"], "left")


def with_children(tokens: DataFrame, **counts: Column) -> DataFrame:
    """Adds, by name, how many children of each token fulfil a condition; roots are not their own children."""
    kids = tokens.where("head_i <> i").groupBy(*SENTENCE, F.col("head_i").alias("i")).agg(*(F.count_if(c).alias(n) for n, c in counts.items()))
    return tokens.join(kids, [*SENTENCE, "i"], "left").fillna(0, list(counts))


def ancestors(tokens: DataFrame, depth: int = 8) -> DataFrame:
    """(sentence, i, a, pasos): every ancestor of a token up to ``depth`` steps, by one join a step."""
    link = tokens.where("head_i <> i").select(*SENTENCE, "i", F.col("head_i").alias("a"))
    step = link.withColumn("pasos", F.lit(1))
    out = step
    for k in range(2, depth + 1):
        up = link.select(*SENTENCE, F.col("i").alias("a"), F.col("a").alias("b"))
        step = step.join(up, [*SENTENCE, "a"]).select(*SENTENCE, "i", F.col("b").alias("a"), F.lit(k).alias("pasos"))
        out = out.unionByName(step)
    return out


def morph(key: str) -> Column:
    return F.col("morph")[key]


def negations(tokens: DataFrame) -> DataFrame:
    """Negative words with their type, the scope (head; of an auxiliary its participle's verb) and the NPIs of the sentence."""
    is_neg = _in(F.col("lower"), es.NEGATORS) | (morph("Polarity") == "Neg")
    npis = tokens.where(_in(F.col("lower"), es.NEGATIVE_POLARITY)).groupBy(*SENTENCE).agg(F.sort_array(F.collect_list("lower")).alias("npis"))
    neg = with_head(tokens.withColumn("_neg", is_neg), "text", "pos", "lemma", "head_i").where("_neg")
    upper = tokens.select(*SENTENCE, F.col("i").alias("h_head_i"), F.col("text").alias("hh_text"), F.col("pos").alias("hh_pos"))
    climbed = neg.join(upper, [*SENTENCE, "h_head_i"], "left")
    climb = F.col("h_pos").isin("AUX", "PART") & F.col("hh_pos").isNotNull()
    scope, scope_pos = F.when(climb, F.col("hh_text")).otherwise(F.col("h_text")), F.when(climb, F.col("hh_pos")).otherwise(F.col("h_pos"))
    kind = negation_kind(F.col("dep"), F.col("lower"), scope_pos)
    constituent = scope_pos.isin("NOUN", "PROPN", "PRON", "ADJ", "ADV") & ~climb
    return climbed.join(npis, SENTENCE, "left").select(
        *SENTENCE, "i", F.col("text").alias("texto"), F.when(constituent, F.concat(kind, F.lit("_CONSTITUYENTE"))).otherwise(kind).alias("tipo"),
        scope.alias("alcance"), scope_pos.alias("alcance_pos"), constituent.alias("es_constituyente"), F.coalesce("npis", F.array()).alias("npis"), "char_start", "char_end",
    )


def negation_kind(dep: Column, lower: Column, scope_pos: Column) -> Column:
    adverbial = F.when(scope_pos.isin("VERB", "AUX"), "NEGACION_VERBAL").when(scope_pos.isin("ADJ", "ADV"), "NEGACION_DE_GRADO").otherwise("NEGACION_ADVERBIAL")
    return F.when(dep == "advmod", adverbial).when(dep == "det", "NEGACION_NOMINAL").when((dep == "cc") & (lower == "ni"), "NEGACION_CONJUNTIVA").otherwise("OTRA")


def repaired_npis(tokens: DataFrame) -> DataFrame:
    """Negative-polarity words whose head is no verb, hung on the nearest negated verb of the sentence."""
    kids = with_children(tokens, _n=_in(F.col("lower"), es.NEGATORS))
    verbs = kids.where(F.col("pos").isin("VERB", "AUX") & (F.col("_n") > 0)).select(*SENTENCE, F.col("i").alias("v"))
    loose = with_head(tokens, "pos").where(_in(F.col("lower"), es.NEGATIVE_POLARITY) & ~F.col("h_pos").isin("VERB", "AUX"))
    nearest = loose.join(verbs, SENTENCE).groupBy(*SENTENCE, "i").agg(F.min_by("v", F.struct(F.abs(F.col("i") - F.col("v")), "v")).alias("nuevo"))
    return tokens.join(nearest, [*SENTENCE, "i"], "left").withColumn("head_i", F.coalesce("nuevo", "head_i")).drop("nuevo")


def unlicensed_npis(tokens: DataFrame) -> DataFrame:
    """Negative-polarity words outside idioms, with no negator before them and no other in a sentence they do not open."""
    window = Window.partitionBy(*SENTENCE).orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    negated = F.coalesce(F.max(_in(F.col("lower"), es.NEGATORS).cast("int")).over(window), F.lit(0))
    verb = F.coalesce(F.max(F.col("pos").isin("VERB", "AUX").cast("int")).over(window), F.lit(0))
    found = tokens.withColumn("_n", negated).withColumn("_v", verb).where(_in(F.col("lower"), [w for w in es.NEGATIVE_POLARITY if w not in es.NEGATORS]) & (F.col("_n") == 0) & (F.col("_v") == 1)).select(*SENTENCE, "i", "text")
    idioms = phrases(tokens, {"idioma": es.NPI_IDIOMS}).select(*SENTENCE, F.explode(F.sequence(F.col("i"), F.col("i") + F.col("n") - 1)).alias("i"))
    return found.join(idioms, [*SENTENCE, "i"], "left_anti")


def pronouns(tokens: DataFrame) -> DataFrame:
    """Explicit, enclitic and null pronouns and contractions, one row each."""
    subtype = (
        F.when(morph("Reflex") == "Yes", "REFLEXIVO").when(morph("PronType") == "Prs", "PERSONAL").when(morph("PronType") == "Dem", "DEMOSTRATIVO")
        .when(morph("PronType") == "Rel", "RELATIVO").when(morph("PronType") == "Int", "INTERROGATIVO").when(morph("PronType") == "Ind", "INDEFINIDO").otherwise("OTRO")
    )
    columns = [*SENTENCE, "i", "text"]
    explicit = tokens.where("pos = 'PRON'").select(*columns, F.lit("EXPLICITO").alias("tipo"), subtype.alias("subtipo"), (~_in(F.col("lower"), es.NON_REFERENTIAL)).alias("referencial"))
    joined = tokens.where(F.col("pos").isin("VERB", "AUX") & morph("VerbForm").isin("Inf", "Ger")).withColumn("_e", T.enclitic(F.col("lower"))).where("_e is not null")
    enclitic = joined.select(*columns, F.lit("ENCLITICO").alias("tipo"), F.col("_e.clitico").alias("subtipo"), F.lit(True).alias("referencial"))
    subjects = with_children(tokens, _s=F.col("dep").contains("subj"))
    null = subjects.where((F.col("pos") == "VERB") & (morph("VerbForm") == "Fin") & (F.col("_s") == 0)).select(*columns, F.lit("NULO").alias("tipo"), F.concat_ws("", morph("Person"), morph("Number")).alias("subtipo"), F.lit(True).alias("referencial"))
    short = tokens.where(F.col("lower").isin("al", "del")).select(*columns, F.lit("CONTRACCION").alias("tipo"), F.array_join(T.expand_contraction(F.col("lower")), "+").alias("subtipo"), F.lit(False).alias("referencial"))
    return explicit.unionByName(enclitic).unionByName(null).unionByName(short)


def pronoun_profile(found: DataFrame) -> DataFrame:
    """Counts by type and by subtype (grouping sets) and the share of null among null and explicit subjects."""
    both = found.groupingSets([("tipo",), ("subtipo",)], "tipo", "subtipo").agg(F.count(F.lit(1)).cast("double").alias("valor"))
    n = lambda t: F.count_if(F.col("tipo") == t)
    ratio = found.agg((n("NULO") / F.greatest(n("NULO") + n("EXPLICITO"), F.lit(1))).alias("valor")).select(F.lit("RATIO_NULO").alias("tipo"), F.lit(None).cast("string").alias("subtipo"), "valor")
    return both.unionByName(ratio)


def verbs(tokens: DataFrame) -> DataFrame:
    """Verbs and auxiliaries with mood, tense, aspect, voice, person, number, periphrasis, valency and clause type."""
    kids = with_children(
        tokens, sujetos=F.col("dep").startswith("nsubj"), objetos=F.col("dep") == "obj", indirectos=F.col("dep") == "iobj", oblicuos=F.col("dep") == "obl",
        _pass=F.col("dep").isin("nsubj:pass", "aux:pass"), _prog=(F.col("lemma") == "estar") & (F.col("pos") == "AUX"), _haber=(F.col("lemma") == "haber") & (F.col("pos") == "AUX"),
        _se=(F.col("lower") == "se") & F.col("dep").startswith("expl"), _mark=(F.col("dep") == "mark") & (F.col("pos") == "SCONJ"),
        _clause=F.col("dep").isin("xcomp", "advcl") & (F.col("pos") == "VERB") & morph("VerbForm").isin("Inf", "Ger"),
    ).where(F.col("pos").isin("VERB", "AUX"))
    finite = morph("VerbForm") == "Fin"
    aspect = (
        F.when(morph("Aspect").isNotNull(), morph("Aspect")).when((morph("VerbForm") == "Ger") | (F.col("_prog") > 0), "Imp")
        .when((morph("VerbForm") == "Part") | (F.col("_haber") > 0), "Perf").when(morph("Tense") == "Imp", "Imp").when(morph("Tense") == "Past", "Perf")
    )
    se = (
        F.when((F.col("_se") > 0) & (morph("Person") == "3") & (F.col("sujetos") > 0), "PASIVA_REFLEJA")
        .when((F.col("_se") > 0) & (morph("Person") == "3") & (morph("Number") == "Sing"), "IMPERSONAL").when(F.col("_se") > 0, "MEDIA")
    )
    voice = F.when(F.col("_pass") > 0, "Pass").otherwise(F.coalesce(se, F.lit("Act")))
    return kids.select(
        *SENTENCE, "i", "text", "lemma", "pos", morph("Mood").alias("modo"), morph("Tense").alias("tiempo"), aspect.alias("aspecto"), voice.alias("voz"),
        morph("Person").alias("persona"), morph("Number").alias("numero"), F.when(finite & (F.col("pos") == "VERB"), F.greatest("sujetos", F.lit(1))).otherwise(F.col("sujetos")).alias("sujetos"),
        "objetos", "indirectos", "oblicuos", (_in(F.col("lemma"), es.PERIPHRASIS_VERBS) & (F.col("_clause") > 0)).alias("perifrasis"),
        (F.col("dep").isin("ccomp", "xcomp", "advcl", "relcl", "acl:relcl") | (F.col("_mark") > 0)).alias("subordinado"), "dep", "head_i", "char_start", "char_end",
    )


def lookup(spark: SparkSession, pairs: list[tuple], schema: str) -> DataFrame:
    """A closed lexicon as a table, for a broadcast join: its size is fixed."""
    return F.broadcast(spark.createDataFrame(pairs, schema))


def subordinations(tokens: DataFrame) -> DataFrame:
    """Subordinating conjunctions with their type and subtype."""
    table = lookup(tokens.sparkSession, [(k, a, b) for k, (a, b) in es.SUBORDINATORS.items() if " " not in k], "lower string, tipo string, subtipo string")
    return tokens.where("pos = 'SCONJ'").join(table, "lower").select(*SENTENCE, "i", "lower", "tipo", "subtipo")


def participle_agreement(tokens: DataFrame) -> DataFrame:
    """Participles under a form of ser or estar whose gender or number is not that of the subject."""
    subject = tokens.where("dep like 'nsubj%'").select(*SENTENCE, F.col("head_i").alias("i"), morph("Gender").alias("sg"), morph("Number").alias("sn"))
    kids = with_children(tokens, _cop=F.col("lemma").isin("ser", "estar") & F.col("dep").isin("cop", "aux", "aux:pass"))
    parts = kids.where((morph("VerbForm") == "Part") & (F.col("_cop") > 0)).join(subject, [*SENTENCE, "i"])
    return parts.where((morph("Gender") != F.col("sg")) | (morph("Number") != F.col("sn"))).select(*SENTENCE, "i", "text")


def phrases(tokens: DataFrame, lexicon: dict[str, list[str]], most: int = 5) -> DataFrame:
    """Occurrences of words and phrases of a lexicon (category to words), the longest at each place first.

    Each token carries the next words as leads; every length is looked up in a fixed broadcast table.
    """
    pairs = [(w, c, len(w.split())) for c, ws in lexicon.items() for w in ws]
    table = lookup(tokens.sparkSession, pairs, "frase string, categoria string, n int")
    window = Window.partitionBy("doc_id", "uce_id").orderBy("i")
    words = tokens.where("not is_punct").select(*SENTENCE, "i", "lower", *(F.lead("lower", k).over(window).alias(f"w{k}") for k in range(1, most)))
    words = words.where(_in(F.col("lower"), sorted({w.split()[0] for w, *_ in pairs})))  # only where a phrase can begin
    longest = max(n for *_, n in pairs)
    spans = F.array(*(F.when(F.lit(True) if k == 1 else F.col(f"w{k - 1}").isNotNull(), F.struct(F.concat_ws(" ", "lower", *(f"w{j}" for j in range(1, k))).alias("frase"), F.lit(k).alias("n"))) for k in range(1, min(most, longest) + 1)))
    hits = words.select(*SENTENCE, "i", F.explode(F.filter(spans, lambda x: x.isNotNull())).alias("x")).select(*SENTENCE, "i", "x.frase", "x.n").join(table, ["frase", "n"])
    ahead = F.max(F.col("i") + F.col("n")).over(Window.partitionBy("doc_id", "uce_id").orderBy("i", F.desc("n")).rowsBetween(Window.unboundedPreceding, -1))
    return hits.withColumn("_a", F.coalesce(ahead, F.lit(-1))).where("i >= _a").drop("_a")


def adverbs(tokens: DataFrame) -> DataFrame:
    """Adverbs and adverbial phrases with their category; single words among the blocked ones are left out."""
    return phrases(tokens, es.ADVERBS).where(~F.col("frase").isin(es.ADVERBS_BLOCKED))


def adverb_window(tokens: DataFrame, width: int = 10) -> DataFrame:
    """First and last token of the window of each adverb: itself, its head and the head's children, cut to ``width`` either way."""
    kids = tokens.where("head_i <> i").groupBy(*SENTENCE, F.col("head_i").alias("h")).agg(F.min("i").alias("lo"), F.max("i").alias("hi"))
    adv = tokens.where("pos = 'ADV'").select(*SENTENCE, "i", F.col("head_i").alias("h"))
    joined = adv.join(kids, [*SENTENCE, "h"], "left")
    low, high = F.least("i", "h", F.coalesce("lo", "i")), F.greatest("i", "h", F.coalesce("hi", "i"))
    wide = high - low > 2 * width
    return joined.select(*SENTENCE, "i", F.when(wide, F.greatest(low, F.col("i") - width)).otherwise(low).alias("desde"), F.when(wide, F.least(high, F.col("i") + width)).otherwise(high).alias("hasta"))


def discourse_markers(tokens: DataFrame) -> DataFrame:
    """Locutions by category, and loose connectors at the start or the end of a stretch between marks."""
    found = phrases(tokens, es.LOCUTIONS, 6).select(*SENTENCE, "i", "frase", "categoria", "n")
    window = Window.partitionBy("doc_id", "uce_id").orderBy("i")
    place = F.when(F.lag("is_punct").over(window).isNull() | F.lag("is_punct").over(window), "INICIO").when(F.lead("is_punct").over(window).isNull() | F.lead("is_punct").over(window), "FINAL").otherwise("MEDIAL")
    placed = tokens.withColumn("posicion", place)
    loose = placed.where(_in(F.col("lower"), es.CONNECTORS) & F.col("pos").isin("CCONJ", "SCONJ", "INTJ", "ADV") & (F.col("posicion") != "MEDIAL"))
    out = found.join(placed.select(*SENTENCE, "i", "posicion"), [*SENTENCE, "i"])
    return out.unionByName(loose.select(*SENTENCE, "i", F.col("lower").alias("frase"), F.lit("CONECTORES").alias("categoria"), F.lit(1).alias("n"), "posicion"))


def marker_density(tokens: DataFrame, markers: DataFrame) -> DataFrame:
    """Markers per hundred words of each unit."""
    words = tokens.where("not is_punct").groupBy("doc_id", "uce_id").agg(F.count(F.lit(1)).alias("palabras"))
    found = markers.groupBy("doc_id", "uce_id").agg(F.count(F.lit(1)).alias("marcadores"))
    return words.join(found, ["doc_id", "uce_id"], "left").fillna(0, ["marcadores"]).withColumn("densidad", F.col("marcadores") / F.col("palabras") * 100)


def quantifiers(tokens: DataFrame) -> DataFrame:
    """Quantifiers with their type and what they quantify: the first noun or pronoun among their head and children."""
    table = lookup(tokens.sparkSession, [(w, t) for t, ws in es.QUANTIFIERS.items() for w in ws], "lower string, tipo string")
    plain = with_head(tokens, "text", "pos")
    known = plain.where(F.col("pos").isin("DET", "PRON", "ADJ", "NUM")).join(table, "lower", "left")
    kind = F.coalesce("tipo", F.when((F.col("pos") == "NUM") & (F.coalesce(morph("NumType"), F.lit("Card")) == "Card"), "NUMERAL_CARDINAL").when(morph("NumType") == "Ord", "NUMERAL_ORDINAL"))
    return known.withColumn("tipo", kind).where("tipo is not null").select(*SENTENCE, "i", F.col("text").alias("cuantificador"), "tipo", F.when(F.col("h_pos").isin("NOUN", "PRON", "PROPN") & (F.col("head_i") != F.col("i")), F.col("h_text")).alias("cuantificado"))


def insubordinations(tokens: DataFrame) -> DataFrame:
    """Sentences that open with a loose subordinator hung on the root, and their function."""
    window = Window.partitionBy(*SENTENCE).orderBy("i")
    first = tokens.where("not is_punct").withColumn("r", F.row_number().over(window)).withColumn("w2", F.lead("lower").over(window)).where("r = 1")
    opened = F.when(F.concat_ws(" ", "lower", "w2") == "pero si", "pero si").otherwise(F.col("lower"))
    names = F.create_map(*(F.lit(x) for x in chain.from_iterable(es.INSUBORDINATION.items())))
    found = with_head_of(first, tokens).withColumn("apertura", opened).where(_in(F.col("apertura"), es.INSUBORDINATION) & F.col("pos").isin("SCONJ", "CCONJ") & (F.col("h_root") | (F.col("head_i") == F.col("i"))))
    return found.select(*SENTENCE, "apertura", names[F.col("apertura")].alias("funcion"))


def with_head_of(some: DataFrame, tokens: DataFrame) -> DataFrame:
    """Adds h_root: whether the head of a row's token is a root."""
    roots = tokens.where("head_i = i").select(*SENTENCE, F.col("i").alias("head_i")).distinct().withColumn("h_root", F.lit(True))
    return some.join(roots, [*SENTENCE, "head_i"], "left").fillna(False, ["h_root"])


def rarities(tokens: DataFrame) -> DataFrame:
    """Three patterns of heads: verb + de + que, doubled clitic, possessive after a preposition or adverb."""
    head = with_head(tokens, "pos", "lower", "i", "head_i")
    columns = [*SENTENCE, F.col("h_i").alias("i")]
    de_que = head.where("lower = 'que' and h_lower = 'de'").select(*SENTENCE, F.col("h_head_i").alias("i")).join(tokens.where("pos = 'VERB'").select(*SENTENCE, "i"), [*SENTENCE, "i"]).withColumn("patron", F.lit("DEQUEISMO"))
    clitic = head.where(F.col("lower").isin("lo", "la", "los", "las", "le", "les") & (F.col("pos") == "PRON") & (F.col("h_pos") == "VERB")).select(*columns).distinct()
    named = head.where("pos = 'PROPN' and h_lower = 'a' and h_pos = 'ADP'").select(*SENTENCE, F.col("h_head_i").alias("i")).distinct()
    doubled = clitic.join(named, [*SENTENCE, "i"]).withColumn("patron", F.lit("DOBLADO_CLITICO"))
    possessive = head.where(_in(F.col("lower"), es.POSSESSIVES) & F.col("h_pos").isin("ADP", "ADV")).select(*columns).withColumn("patron", F.lit("POSESIVO_POSPUESTO"))
    return de_que.unionByName(doubled).unionByName(possessive)


def tree_depth(tokens: DataFrame) -> DataFrame:
    """SENTENCE, profundidad: steps from the deepest token of a sentence to its root; a loop of heads counts once round.

    The heads of a sentence go to its row once, whatever the depth of the tree.
    """

    @F.pandas_udf("int")
    def depth(links: pd.Series) -> pd.Series:
        out = []
        for found in links:
            head = {x["i"]: x["h"] for x in found}
            known: dict[int, int] = {}
            for i in head:
                path = []
                while i not in known and i in head and head[i] != i and i not in path:
                    path.append(i)
                    i = head[i]
                at = known.get(i, 0)
                for j in reversed(path):
                    at += 1
                    known[j] = at
            out.append(max(known.values(), default=0))
        return pd.Series(out, dtype="int32")

    lists = tokens.where("head_i <> i").groupBy(*SENTENCE).agg(F.collect_list(F.struct("i", F.col("head_i").alias("h"))).alias("l"))
    return lists.select(*SENTENCE, depth("l").alias("profundidad"))


def complexity(tokens: DataFrame, most: int = 50) -> DataFrame:
    """Depth of the tree, clauses, mean distance to the head and share of heads to the left, by unit."""
    depth = tree_depth(tokens).groupBy("doc_id", "uce_id").agg(F.least(F.max("profundidad"), F.lit(most)).alias("profundidad"))
    inner = tokens.where("head_i <> i")
    base = tokens.groupBy("doc_id", "uce_id").agg(F.countDistinct("sent_id").alias("oraciones"), F.count_if(F.col("dep").isin("ccomp", "xcomp", "advcl", "acl", "relcl", "acl:relcl")).alias("recursividad"))
    right = F.count_if(F.col("i") > F.col("head_i"))
    reach = inner.groupBy("doc_id", "uce_id").agg(F.avg(F.abs(F.col("i") - F.col("head_i"))).alias("distancia"), (right / F.count(F.lit(1))).alias("ramificacion"))
    return base.join(depth, ["doc_id", "uce_id"], "left").join(reach, ["doc_id", "uce_id"], "left").fillna({"profundidad": 0, "distancia": 0.0, "ramificacion": 0.5}).withColumn("por_oracion", F.col("recursividad") / F.col("oraciones"))


def kwic(texts: DataFrame, key: str, text: str, word: str, width: int = 40) -> DataFrame:
    """Concordance of a fixed string without regard to case: place, left and right context of every hit, in the JVM."""
    low = F.lower(text)
    step = len(word)
    # places of the hits: lengths of the pieces between them, added up
    parts = F.split(low, F.concat(F.lit("\\Q"), F.lit(word.lower()), F.lit("\\E")), -1)
    listed = texts.where(F.contains(low, F.lit(word.lower()))).select(key, text, F.posexplode(F.slice(parts, 1, F.size(parts) - 1)).alias("hit", "pieza"))
    before = F.sum(F.length("pieza") + step).over(Window.partitionBy(key).orderBy("hit"))
    at = listed.withColumn("inicio", (before - step).cast("int"))
    start = F.greatest(F.col("inicio") - width, F.lit(0))
    return at.select(key, "hit", "inicio", F.substring(text, start + 1, F.col("inicio") - start).alias("izquierda"), F.substring(text, F.col("inicio") + step + 1, F.lit(width)).alias("derecha"))


def annotations(**families: DataFrame) -> DataFrame:
    """One long table (doc_id, uce_id, familia, i, atributos map) of the rules' results, for profiles by union and count."""
    out = None
    for name, df in families.items():
        rest = [c for c in df.columns if c not in (*SENTENCE, "i")]
        pairs = chain.from_iterable((F.lit(c), F.col(c).cast("string")) for c in rest)
        place = F.col("i") if "i" in df.columns else F.lit(None).cast("int")
        part = df.select("doc_id", "uce_id", F.lit(name).alias("familia"), place.alias("i"), F.create_map(*pairs).alias("atributos"))
        out = part if out is None else out.unionByName(part)
    return out


def feature_counts(annotated: DataFrame, *by: str) -> DataFrame:
    """How often each value of each attribute occurs in each family (and group): the general summary."""
    long = annotated.select("familia", *by, F.explode("atributos").alias("clave", "valor")).where("valor is not null")
    return long.groupBy("familia", *by, "clave", "valor").agg(F.count(F.lit(1)).alias("n"))


def marked_html(texts: DataFrame, spans: DataFrame, key: str, text: str) -> DataFrame:
    """Texts with <span> tags put in from right to left by place."""
    lists = spans.groupBy(key).agg(F.reverse(F.array_sort(F.collect_list(F.struct("inicio", "fin", "clase")))).alias("s"))
    joined = texts.join(lists, key, "left")

    def put(t: Column, s: Column) -> Column:
        inner = F.substring(t, s.inicio + 1, s.fin - s.inicio)
        return F.concat(F.substring(t, F.lit(1), s.inicio), F.lit('<span class="'), s.clase, F.lit('">'), inner, F.lit("</span>"), F.substring(t, s.fin + 1, F.length(t)))

    return joined.select(key, F.aggregate(F.coalesce("s", F.array().cast("array<struct<inicio:int,fin:int,clase:string>>")), F.col(text), put).alias("html"))


CONTENT = ("NOUN", "VERB", "ADJ", "ADV")
MARKERS = ("PRON", "SCONJ", "CCONJ", "INTJ", "DET", "AUX", "ADP")
#: Words that open a new sentence of speech, and those that do so before a comma and a verb.
PIVOTS, PIVOTS_BEFORE_VERB = ("bueno", "entonces"), ("pues", "mira", "claro", "verdad", "bueno", "entonces")


def unit_projection(tokens: DataFrame) -> DataFrame:
    """Per unit: tokens (alphabetic, no marks), content lemmas with place and class, and markers (function words)."""
    alpha = F.col("is_alpha") & ~F.col("is_punct")
    content = F.col("pos").isin(*CONTENT) & ~F.col("is_stop") & F.col("is_alpha")
    marker = ~content & F.col("is_alpha") & (F.col("is_stop") | F.col("pos").isin(*MARKERS))
    ordered = lambda condition, *fields: F.sort_array(F.collect_list(F.when(condition, F.struct("i", *fields))))
    got = tokens.groupBy("doc_id", "uce_id").agg(ordered(alpha, "text").alias("t"), ordered(content, "text", "lemma", "pos").alias("f"), ordered(marker, "lower").alias("m"))
    return got.select("doc_id", "uce_id", F.col("t.text").alias("tokens"), F.col("f").alias("formas"), F.col("f.lemma").alias("lemmas"), F.col("f.pos").alias("pos_tags"), F.col("m.lower").alias("marcadores"))


def pivot_starts(tokens: DataFrame) -> DataFrame:
    """Tokens at which speech starts a sentence: a pivot word, or one before a comma and a verb."""
    window = Window.partitionBy("doc_id", "uce_id").orderBy("i")
    before_verb = F.col("lower").isin(*PIVOTS_BEFORE_VERB) & (F.lead("text", 1).over(window) == ",") & (F.lead("pos", 2).over(window) == "VERB")
    return tokens.withColumn("inicia", F.col("lower").isin(*PIVOTS) | F.coalesce(before_verb, F.lit(False)))


def has_substance(tokens: DataFrame, least: int = 4) -> DataFrame:
    """Units with at least ``least`` content words: only these can be a boundary."""
    return tokens.groupBy("doc_id", "uce_id").agg((F.count_if(F.col("pos").isin(*CONTENT)) >= least).alias("sustancia"))


def dependency_profile(tokens: DataFrame) -> DataFrame:
    """Map of relative frequencies of dependency labels in each unit."""
    counts = tokens.groupBy("doc_id", "uce_id", "dep").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy("doc_id", "uce_id"))
    return counts.withColumn("p", F.col("n") / total).groupBy("doc_id", "uce_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("dep", "p")))).alias("perfil"))


def profile_distance(a: Column, b: Column) -> Column:
    """1 - cosine of two maps of frequencies."""
    both = F.map_zip_with(a, b, lambda _, x, y: F.coalesce(x, F.lit(0.0)) * F.coalesce(y, F.lit(0.0)))
    total = lambda m: F.aggregate(F.map_values(m), F.lit(0.0), lambda s, v: s + v)
    square = lambda m: total(F.transform_values(m, lambda _, v: v * v))
    scale = F.sqrt(square(a) * square(b))
    return F.when(scale > 0, 1 - total(both) / scale).otherwise(1.0)


def surprisal_map(tokens: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Per unit a map from a content token's start to its surprisal in bits by the lexicon."""
    rate = lexicon.select(F.col("word").alias("lower"), "subtlwf")
    scored = tokens.where(F.col("pos").isin(*CONTENT) & F.col("is_alpha") & F.col("char_start").isNotNull()).join(rate, "lower", "left")
    bits = -F.log2(F.greatest(F.coalesce("subtlwf", F.lit(0.01)) / 1e6, F.lit(1e-10)))
    return scored.groupBy("doc_id", "uce_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("char_start", bits.alias("bits"))))).alias("sorpresa"))


def context_embedding(tokens: DataFrame, vectors: DataFrame, dim: int, width: int = 2) -> DataFrame:
    """Per token the mean vectors to the left, of itself and to the right, one after another; their norm is the density."""
    joined = tokens.join(vectors.select(F.col("word").alias("lower"), "vec"), "lower", "left")
    window = Window.partitionBy("doc_id", "uce_id").orderBy("i")
    side = lambda low, high: F.array(*(F.coalesce(F.avg(F.col("vec")[k].cast("double")).over(window.rowsBetween(low, high)), F.lit(0.0)) for k in range(dim)))
    whole = F.concat(side(-width, -1), side(0, 0), side(1, width))
    return joined.select(*SENTENCE, "i", whole.alias("contexto")).withColumn("densidad", F.sqrt(F.aggregate("contexto", F.lit(0.0), lambda s, x: s + x * x)))


def in_negation(verbs: DataFrame, scopes: DataFrame) -> DataFrame:
    """Verbs with negacion: whether the start lies in a negation's scope [lo, hi] of the same sentence."""
    key = [*SENTENCE, "i"]
    inside = verbs.join(scopes, SENTENCE).where("char_start between lo and hi").select(*key).distinct().withColumn("negacion", F.lit(True))
    return verbs.join(inside, key, "left").fillna(False, ["negacion"])
