import random

import numpy as np
import pytest

from tesela.llm import chunking


def words(text):
    return chunking._WORD.findall(text)


def check(text, limit, overlap):
    pieces = chunking.pieces_of(text, limit, overlap)
    every = words(text)
    at = 0
    for i, p in enumerate(pieces):
        own = words(text[p["inicio"] : p["fin"]])
        assert len(own) == p["palabras"] <= max(1, limit)
        assert own == every[at : at + len(own)]
        shared = min(overlap, limit - 1) if i + 1 < len(pieces) else 0
        at += len(own) - shared
    assert at == len(every)
    return pieces


@pytest.mark.parametrize("limit,overlap", [(20, 0), (20, 5), (7, 6), (1, 0), (3, 9), (120, 15)])
def test_pieces_cover_the_text_within_the_limit(limit, overlap):
    r = random.Random(limit)
    for n in (1, limit, limit + 1, 5 * limit + 3, 400):
        text = " ".join(r.choice(["a", "bien,", "casa.", "luz;", "No", "Sí.\n\nY", "dr."]) for _ in range(n))
        check(text, limit, overlap)


def test_every_piece_ends_at_a_boundary_where_there_is_one():
    r = random.Random(3)
    for _ in range(50):
        text = " ".join("palabra" + ("." if r.random() < 0.08 else "") for _ in range(300))
        spans = [m.span() for m in chunking._WORD.finditer(text)]
        strength = chunking.boundary_strengths(text, spans)
        plan = chunking.plan_pieces(strength, 40, 5)
        for a, b in plan[:-1]:
            if (strength[a + 5 : a + 40] > 0).any():
                assert strength[b - 1] > 0


def test_least_number_of_balanced_pieces_without_boundaries():
    plan = chunking.plan_pieces(np.zeros(101, dtype=int), 50, 0)
    assert len(plan) == 3 and max(b - a for a, b in plan) - min(b - a for a, b in plan) <= 1


def test_paragraphs_win_over_commas():
    text = "uno dos tres cuatro, cinco seis.\n\nsiete ocho nueve diez, once doce"
    pieces = chunking.pieces_of(text, 8, 0)
    assert text[pieces[0]["inicio"] : pieces[0]["fin"]].endswith("seis.")


def test_words_are_parted_by_every_white_space():
    assert words("a\xa0b c　d e\tf\x85g") == list("abcdefg")
    assert chunking.pieces_of(None, 5, 0) is None and chunking.pieces_of(" \xa0\n", 5, 0) is None


def test_frame_with_odd_rows(spark):
    long = "palabra " * 5000
    rows = [("t", "1", "corto", 1, "x"), ("t", "1", "corto", 1, "x"), ("t", "2", None, 1, "x"), ("t", "3", "", None, "x"), ("t", "4", long, None, "x"), ("t", "5", long, 99, "x")]
    texts = spark.createDataFrame(rows, "tabla string, clave string, texto string, config_id int, limite string")
    texts = texts.withColumn("n", texts.limite).withColumn("piezas", texts.limite)
    config = spark.createDataFrame([(1, 5, 100, 10), (2, 5, 50, 0)], "config_id int, min_tokens_por_uce int, max_tokens_por_uce int, solape_tokens int")
    got = chunking.split_oversized(texts, config).collect()
    by = {}
    for r in got:
        by.setdefault(r["clave"], []).append(r)
    assert set(by) == {"1", "4", "5"} and len(by["1"]) == 2
    assert len(by["4"]) == len(by["5"]) == 56 and all(r["palabras"] <= 100 for r in by["4"])
    assert all(r["trozo"] == (long if r["clave"] in "45" else "corto")[r["inicio"] : r["fin"]] for r in got)
    only = chunking.split_oversized(texts, config, True)
    assert {r["clave"] for r in only.collect()} == {"4", "5"}
    assert chunking.split_oversized(texts.limit(0), config).count() == 0
    assert chunking.split_oversized(texts, config.limit(0), True).count() == 0
