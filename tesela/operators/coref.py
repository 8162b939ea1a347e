"""Coreference chains, predicate frames and the alignment of quotes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesela.functions import text as T
from tesela.operators.network import label_communities


def unique_mentions(mentions: DataFrame) -> DataFrame:
    """Mentions that differ in place: one for each document and range."""
    return mentions.dropDuplicates(["doc_id", "start_char", "end_char"])


def likeness(a: Column, b: Column) -> Column:
    """Likeness of two texts in percent, from their edit distance."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest > 0, (1 - F.levenshtein(a, b) / longest) * 100).otherwise(100.0)


def merged_chains(chains: DataFrame, least: float = 85.0) -> DataFrame:
    """doc_id, chain_id, entidad: chains of a document whose normalised representatives are alike are one entity.

    Pairs are sought among representatives that share a word only; the components of the pairs do not hang on the
    order of the chains.
    """
    named = chains.select("doc_id", "chain_id", T.representative(F.col("representative")).alias("rep"))
    # chains of one representative are one already; only different ones are compared
    words = named.where("rep <> ''").select("doc_id", "rep").distinct().select("*", F.explode(F.array_distinct(F.split("rep", " "))).alias("w"))
    other = words.select("doc_id", "w", F.col("rep").alias("rep2"))
    pairs = words.join(other, ["doc_id", "w"]).where("rep < rep2").where(likeness(F.col("rep"), F.col("rep2")) >= least)
    edges = pairs.select(F.concat_ws("/", "doc_id", "rep").alias("a"), F.concat_ws("/", "doc_id", "rep2").alias("b")).distinct()
    groups = label_communities(edges)
    keyed = named.withColumn("nodo", F.when(F.col("rep") == "", F.concat_ws("/", "doc_id", "chain_id")).otherwise(F.concat_ws("/", "doc_id", "rep")))
    return keyed.join(groups, "nodo", "left").select("doc_id", "chain_id", F.coalesce("grupo", F.xxhash64("nodo")).alias("entidad"))


def mentions_in_units(mentions: DataFrame, units: DataFrame) -> DataFrame:
    """Mentions with the unit whose [start_char, end_char) their start is in: an equi-join by document, then the range."""
    u = units.select("doc_id", "uce_id", F.col("start_char").alias("u0"), F.col("end_char").alias("u1"))
    return mentions.join(u, "doc_id").where("start_char >= u0 and start_char < u1").drop("u0", "u1")


def coverage(mentions: DataFrame, units: DataFrame) -> DataFrame:
    """Number of chains and share of units with a mention, by document."""
    placed = mentions_in_units(mentions, units).select("doc_id", "uce_id", "chain_id").distinct()
    per = placed.groupBy("doc_id").agg(F.countDistinct("chain_id").alias("n_cadenas"), F.countDistinct("uce_id").alias("con"))
    return units.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).join(per, "doc_id", "left").select("doc_id", F.coalesce("n_cadenas", F.lit(0)).alias("n_cadenas"), (F.coalesce("con", F.lit(0)) / F.col("n")).alias("cobertura"))


def bridged_segments(mentions: DataFrame, segments: DataFrame) -> DataFrame:
    """Neighbouring segments of a document that share a chain."""
    s = segments.select("doc_id", "segmento", F.col("s_start"), F.col("s_end"))
    placed = mentions.join(s, "doc_id").where("start_char >= s_start and start_char < s_end").select("doc_id", "chain_id", "segmento").distinct()
    after = placed.select("doc_id", "chain_id", (F.col("segmento") - 1).alias("segmento"))
    return placed.join(after, ["doc_id", "chain_id", "segmento"]).select("doc_id", "segmento").distinct()


def thematic_role(dep: Column, preposition: Column, voice: Column) -> Column:
    return (
        F.when(dep.startswith("nsubj"), F.when(voice == "Pass", "PATIENT").otherwise("AGENT")).when(dep == "obj", "PATIENT").when(dep == "iobj", "RECIPIENT")
        .when((dep == "obl") & (preposition == "por"), "AGENT").when((dep == "obl") & preposition.isin("para", "a"), "RECIPIENT").when(dep == "obl", "OBLIQUE")
        .when(dep == "nmod", "MODIFIER").otherwise("UNSPECIFIED")
    )


def frames(tokens: DataFrame, verbs: DataFrame) -> DataFrame:
    """Predicate frames: each argument of a verb with its role and the frame's fingerprint "verb object voice NEG"."""
    key = ["doc_id", "uce_id", "sent_id"]
    kids = tokens.where("head_i <> i")
    objects = kids.where("dep = 'obj'").groupBy(*key, F.col("head_i").alias("i")).agg(F.min_by("lemma", "i").alias("object_lemma"))
    denied = kids.where(F.col("lower").isin("no", "nunca", "jamás", "tampoco")).select(*key, F.col("head_i").alias("i")).distinct().withColumn("negated", F.lit(True))
    preposition = kids.where("dep = 'case'").groupBy(*key, F.col("head_i").alias("a_i")).agg(F.min_by("lower", "i").alias("prep"))
    v = verbs.where("pos = 'VERB'").select(*key, "i", F.col("lemma").alias("verb_lemma"), F.col("voz").alias("voice")).join(objects, [*key, "i"], "left").join(denied, [*key, "i"], "left").fillna(False, ["negated"])
    arguments = kids.where(F.col("dep").rlike("^(nsubj|obj|iobj|obl|nmod)")).select(*key, F.col("head_i").alias("i"), F.col("i").alias("a_i"), F.col("text").alias("entity_text"), F.col("lemma").alias("entity_lemma"), "dep")
    joined = arguments.join(v, [*key, "i"]).join(preposition, [*key, "a_i"], "left")
    print_ = F.concat_ws(" ", "verb_lemma", "object_lemma", "voice", F.when(F.col("negated"), "NEG"))
    return joined.select(*key, "i", "entity_text", "entity_lemma", "verb_lemma", "object_lemma", "voice", "negated", thematic_role(F.col("dep"), F.col("prep"), F.col("voice")).alias("role"), print_.alias("fingerprint"))


def chain_summary(frames: DataFrame, chain: str, cluster: str) -> DataFrame:
    """Frames, dominant class and role, share of roles, first eight verbs and objects, units and expansions of each chain."""
    eight = lambda c: F.slice(F.array_sort(F.collect_set(c)), 1, 8)
    share = lambda r: F.avg((F.col("role") == r).cast("double"))
    return frames.where(F.col(chain).isNotNull()).groupBy(chain).agg(
        F.count(F.lit(1)).alias("n_frames"), F.mode(cluster, True).alias("clase"), F.mode("role", True).alias("rol"), share("AGENT").alias("agente"), share("PATIENT").alias("paciente"),
        eight("verb_lemma").alias("verbos"), eight("object_lemma").alias("objetos"), F.countDistinct("uce_id").alias("n_uces"), F.count_if(F.col("is_expansion")).alias("n_expansiones"),
    )


def frame_graph(frames: DataFrame, frame: str, doc: str, chain: str) -> DataFrame:
    """Edges between frames one after another in a chain: 2 over documents, 1 within one; the greatest weight counts."""
    from pyspark.sql import Window

    def links(by: list[str], weight: float) -> DataFrame:
        window = Window.partitionBy(*by).orderBy(frame)
        return frames.where(F.col(chain).isNotNull()).select(F.col(frame).cast("string").alias("b"), F.lag(F.col(frame).cast("string")).over(window).alias("a"), F.lit(weight).alias("peso")).where("a is not null")

    return links([chain], 2.0).union(links([doc, chain], 1.0)).groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("peso").alias("peso"))


def cross_document(chains: DataFrame, rep: str, doc: str, size: str) -> DataFrame:
    """Representatives, without regard to case and blanks at the ends, with their documents and mentions."""
    return chains.groupBy(F.lower(F.trim(rep)).alias("entidad")).agg(F.countDistinct(doc).alias("n_docs"), F.sum(size).alias("menciones"))


def aligned_quotes(quotes: DataFrame, units: DataFrame, key: str, unit: str, quote: str, text: str, least: float = 82.0) -> DataFrame:
    """key, inicio, fin, metodo: where each quote stands in its unit.

    First the quote without marks around it, then as written, then with any white space and without regard to case,
    all in the JVM; only what is left goes to the fuzzy search, which slides windows of 1, 1.15 and 0.85 times the
    quote's length in steps of a quarter and takes the best of at least ``least`` percent. Not found: -1.
    """
    joined = quotes.select(key, unit, F.col(quote).alias("q")).where("q is not null and q <> ''").join(units.select(unit, F.col(text).alias("t")).where("t is not null"), unit)
    clean = T.clean_quote(F.col("q"))
    flat = lambda c: F.lower(F.regexp_replace(c, "\\s+", " "))
    tried = joined.select(key, "t", clean.alias("c"), F.instr("t", clean).alias("a"), F.call_function("locate", F.col("q"), F.col("t")).alias("b"), F.col("q")).withColumn("a", F.when(F.length("c") > 0, F.col("a")).otherwise(0))
    placed = tried.withColumn("d", F.when((F.col("a") == 0) & (F.col("b") == 0) & (F.length("c") > 0) & (F.length(flat(F.col("t"))) == F.length("t")), F.call_function("locate", flat(F.col("c")), flat(F.col("t")))).otherwise(0))
    at, size = F.coalesce(*(F.when(F.col(x) > 0, F.col(x)) for x in "abd")), F.when(F.col("a") > 0, F.length("c")).when(F.col("b") > 0, F.length("q")).otherwise(F.length("c"))
    known = placed.select(key, "t", "c", (at - 1).alias("inicio"), (at - 1 + size).alias("fin"), F.when(F.col("a") > 0, "limpia").when(F.col("b") > 0, "exacta").when(F.col("d") > 0, "flexible").alias("metodo"))
    fuzzy = F.pandas_udf(_fuzzy(least), "struct<inicio:int,fin:int>")
    rest = known.where("metodo is null").select(key, fuzzy("c", "t").alias("x"))
    return known.where("metodo is not null").select(key, "inicio", "fin", "metodo").unionByName(
        rest.select(key, "x.inicio", "x.fin", F.when(F.col("x.inicio") >= 0, "difusa").otherwise("ninguna").alias("metodo"))
    )


def _fuzzy(least: float):
    from difflib import SequenceMatcher

    def one(quote: str, text: str) -> tuple[int, int]:
        best, at = least / 100, (-1, -1)
        n = len(quote)
        if not n or not text:
            return at
        for factor in (1, 1.15, 0.85):
            width = max(1, round(n * factor))
            for i in range(0, max(1, len(text) - width + 1), max(1, width // 4)):
                matcher = SequenceMatcher(None, quote, text[i : i + width], autojunk=False)
                if matcher.real_quick_ratio() > best and matcher.quick_ratio() > best and (r := matcher.ratio()) > best:
                    best, at = r, (i, min(len(text), i + width))
        return at

    def run(quotes: pd.Series, texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(q or "", t or "") for q, t in zip(quotes, texts)], columns=["inicio", "fin"]).astype("int32")

    return run


def frames_in_range(frames: DataFrame, ranges: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Frames of which entity, verb or object overlaps a range [lo, hi) of the same document."""
    overlaps = None
    for part in ("entity", "verb", "object"):
        one = (F.col(f"{part}_start") < F.col("hi")) & (F.col(f"{part}_end") > F.col("lo"))
        overlaps = one if overlaps is None else overlaps | one
    return frames.join(ranges, doc).where(overlaps)


def with_clusters(frames: DataFrame, assigned: DataFrame, key: tuple[str, ...] = ("doc_id", "uce_id", "frame_idx")) -> DataFrame:
    """Frames with the classes written back by key; those without one keep theirs."""
    new = assigned.select(*key, F.col("cluster_id").alias("_c"))
    return frames.join(new, list(key), "left").withColumn("cluster_id", F.coalesce("_c", "cluster_id")).drop("_c")


def cluster_summary(frames: DataFrame, cluster: str, top: int = 5) -> DataFrame:
    """Frames and negated ones of each class, with its most frequent verbs and objects and counts of roles and voices."""
    from pyspark.sql import Window

    def best(column: str) -> DataFrame:
        counts = frames.where(F.col(column).isNotNull()).groupBy(cluster, column).agg(F.count(F.lit(1)).alias("n"))
        rank = F.row_number().over(Window.partitionBy(cluster).orderBy(F.desc("n"), column))
        kept = counts.withColumn("r", rank).where(F.col("r") <= top)
        return kept.groupBy(cluster).agg(F.sort_array(F.collect_list(F.struct("r", column))).alias("x")).select(cluster, F.col(f"x.{column}").alias(f"top_{column}"))

    def spread(column: str) -> DataFrame:
        counts = frames.where(F.col(column).isNotNull()).groupBy(cluster, column).agg(F.count(F.lit(1)).alias("n"))
        return counts.groupBy(cluster).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(column, "n")))).alias(f"por_{column}"))

    out = frames.groupBy(cluster).agg(F.count(F.lit(1)).alias("n_frames"), F.count_if("negated").alias("n_negados"))
    for part in (best("verb_lemma"), best("object_lemma"), spread("role"), spread("voice")):
        out = out.join(part, cluster, "left")
    return out


def similar_pairs(items: DataFrame, key: str, vector: str, least: float = 0.72, top: int = 15, block: int = 4096) -> DataFrame:
    """key_1 < key_2 and coseno of vectors at least so alike, each with its ``top`` best: paraphrases, related nouns.

    Of equal vectors the least key stands for all: copies are not paired with one another. All others are compared,
    none is left out by an index: the items are dealt to blocks of about ``block``, each two blocks meet in one task as
    a product of matrices, and only pairs that are alike leave it. An item goes to as many tasks as there are blocks.
    """
    import numpy as np
    from pyspark.sql import Window

    dim = items.select(F.max(F.size(vector))).first()[0] or 1
    kind = dict(items.dtypes)[key]
    usable = items.where((F.size(vector) == dim) & F.exists(vector, lambda v: v != 0)).groupBy(vector).agg(F.min(key).alias(key)).select(key, vector).checkpoint()
    n = -(-usable.count() // block) or 1

    def compare(part: pd.DataFrame) -> pd.DataFrame:
        i, j = int(part["_i"].iloc[0]), int(part["_j"].iloc[0])

        def side(which: int) -> tuple[np.ndarray, np.ndarray]:
            own = part[part["_b"] == which]
            x = np.stack(own[vector].map(lambda v: np.asarray(v, float)).to_list()) if len(own) else np.zeros((0, dim))
            return own[key].to_numpy(), x / np.linalg.norm(x, axis=1, keepdims=True) if len(x) else x

        (keys_a, a), (keys_b, b) = side(i), side(j)
        ones, twos, values = [], [], []
        for at in range(0, len(a), 512):
            cosine = a[at : at + 512] @ b.T
            r, c = np.nonzero(cosine >= least)
            ones.append(keys_a[r + at])
            twos.append(keys_b[c])
            values.append(cosine[r, c])
        found = pd.DataFrame({"x": np.concatenate(ones) if ones else [], "y": np.concatenate(twos) if twos else [], "coseno": np.concatenate(values) if values else []})
        return found[found["x"] < found["y"]] if i == j else found

    dealt = usable.withColumn("_b", F.pmod(F.xxhash64(key), F.lit(n)).cast("int")).withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    placed = dealt.withColumn("_i", F.least("_b", "_k")).withColumn("_j", F.greatest("_b", "_k"))
    found = placed.groupBy("_i", "_j").applyInPandas(compare, f"x {kind}, y {kind}, coseno double")
    alike = found.select(F.least("x", "y").alias("key_1"), F.greatest("x", "y").alias("key_2"), "coseno")
    rank = F.row_number().over(Window.partitionBy("key_1").orderBy(F.desc("coseno"), "key_2"))
    return alike.withColumn("puesto", rank).where(F.col("puesto") <= top)


def expansions(frames: DataFrame, related: DataFrame) -> DataFrame:
    """Frames of an entity with each related noun in its place, marked as expansions, without places of their own."""
    new = frames.join(related.select(F.col("key_1").alias("entity_lemma"), F.col("key_2").alias("_n")), "entity_lemma")
    return frames.withColumn("is_expansion", F.lit(False)).unionByName(new.withColumn("entity_lemma", F.col("_n")).withColumn("entity_text", F.col("_n")).drop("_n").withColumn("is_expansion", F.lit(True)))
