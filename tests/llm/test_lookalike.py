import itertools

import pytest

from tesela.llm import lookalike

GROUPS = [
    ["El año de la casa", "El año de la casa", "Ｅl año dе la\xa0casa", "El año​ de la ca­sa", "El añο de la casa"],
    ["oficina", "oﬁcina"],
    ["el año de la casa"],
    ["El ano de la casa"],
    ["El año de la  casa"],
    ["x²"],
    ["x2", "ｘ2", "х2"],
    ["½ litro"],
    ["1/2 litro"],
    ["ё", "ë", "ë"],
]


def test_one_form_for_each_group():
    forms = [{lookalike.visible_form(t) for t in g} for g in GROUPS]
    assert all(len(f) == 1 for f in forms) and len(set.union(*forms)) == len(GROUPS)
    assert lookalike.visible_form(None) is None and lookalike.visible_form("") == ""
    for g in GROUPS:
        for t in g:
            assert lookalike.visible_form(lookalike.visible_form(t)) == lookalike.visible_form(t)


def test_coarse_digests_never_part_a_class():
    for g in GROUPS:
        assert len({lookalike._coarse_digest(lookalike.visible_form(t)) for t in g}) == 1


@pytest.fixture(scope="module")
def documents(spark):
    texts = [t for g in GROUPS for t in g] + ["oﬁcina", "oficina", None, "", " ​\xa0", "​", "largo " * 20_000, "ｌargo " * 20_000]
    return spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], "doc_id long, text string, texto string, forma string")


def test_pairs_against_brute_force(documents):
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    want = {
        (a, b)
        for (a, s), (b, t) in itertools.combinations(rows, 2)
        if s and t and s != t and lookalike.visible_form(s) == lookalike.visible_form(t) and lookalike.visible_form(s).strip()
    }
    got = lookalike.look_alike_pairs(lookalike.look_alike_classes(documents)).collect()
    assert len(got) == len(set(map(tuple, got))) and {tuple(r) for r in got} == want and len(want) > 15


def test_canonical_members(documents):
    classes = {r["doc_id"]: r for r in lookalike.look_alike_classes(documents).collect()}
    assert classes[0]["canonico"] == classes[2]["canonico"] == "El año de la casa"
    whole = lookalike.canonical_texts(documents, lookalike.look_alike_classes(documents)).collect()
    assert len(whole) == documents.count() and {r["forma"] for r in whole if r["doc_id"] < 5} == {"El año de la casa"}


def test_confusables_of_every_script(spark):
    letters = lookalike.confusable_letters(spark)
    assert all(letters.get(a) == b for a, b in {"α": "a", "ρ": "p", "ι": "i", "Ꭺ": "A", "а": "a", "О": "O", "ѕ": "s"}.items())
    assert not {"б", "з", "0", "1", "²", "ñ"} & set(letters) and all(a.isupper() == b.isupper() for a, b in letters.items())
    looks = lookalike.Looks(lookalike.character_map(letters))
    assert looks.visible("Ꭺ cαsα ‐ co‑op") == "A casa - co-op"
    for text in ("El año: ¿sí? «no»\n", "ascii", "汉字、かな", "１²½ﬁ", "é", "a\u0301\r\nb", "\xa0", None, ""):
        assert looks.visible(text) == (None if text is None else looks._form(text.replace("\r\n", "\n")))


def test_texts_of_signs_alone(spark):
    """They do not share one digest, and those that look the same are found."""
    assert len({lookalike._coarse_digest(f) for f in ("!!!", "...", "?!", "—", "***")}) == 5
    frame = spark.createDataFrame([(1, "—\xa0!"), (2, "— !"), (3, "—  !"), (4, "..."), (5, "...")], "doc_id long, text string")
    assert [tuple(r) for r in lookalike.look_alike_pairs(lookalike.look_alike_classes(frame)).collect()] == [(1, 2)]


def test_members_have_the_form_of_their_canonical_member(documents, monkeypatch):
    classes = lookalike.look_alike_classes(documents)
    chosen = {r["doc_id"]: r["forma"] for r in classes.collect()}
    for most in (500_000, 0):
        monkeypatch.setattr(lookalike, "BROADCAST_MEMBERS", most)
        whole = {r["doc_id"]: r for r in lookalike.canonical_texts(documents, classes).collect()}
        assert len(whole) == documents.count() and all(whole[k]["forma"] == v and whole[k]["clase"] for k, v in chosen.items())
        assert all(r["clase"] is None for k, r in whole.items() if k not in chosen)


def test_empty_table(documents):
    classes = lookalike.look_alike_classes(documents.limit(0))
    assert classes.count() == 0 and lookalike.look_alike_pairs(classes).count() == 0
