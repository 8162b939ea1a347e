import random

import pytest

from tesela.llm import bpe, mixing

TEXTS = ["", "Hola, ¿qué tal?", "  dos   blancos \n\n\t y  ", "l'été don't 12345 ½ ²", "房东太太慢慢写下。", "emoji 👩‍👩‍👧 fin", "<|endoftext|>", "a" * 3000, "ครูเก่า", "ﬁn​", "x" + "́" * 50]


@pytest.fixture(scope="module")
def encoder():
    return bpe.encoder()


def test_ids_against_the_public_library(encoder):
    tokenizers = pytest.importorskip("tokenizers")
    paths = pytest.importorskip("public_tokenizers")
    public = tokenizers.Tokenizer.from_file(paths.path("byte_bpe_50k.json"))
    public.encode_special_tokens = True
    r = random.Random(1)
    texts = TEXTS + ["".join(chr(r.choice([r.randrange(32, 127), r.randrange(160, 600), r.randrange(0x4E00, 0x4F00), 32])) for _ in range(80)) for _ in range(200)]
    for t in texts:
        assert encoder.encode(t) == public.encode(t, add_special_tokens=False).ids


def test_round_trip(encoder):
    for t in TEXTS:
        assert encoder.decode(encoder.encode(t)) == t
    assert encoder.encode(None) == []


def test_merges_without_cache_are_the_same(encoder):
    fresh = bpe.Encoder(bpe.VOCABULARY)
    for t in TEXTS:
        assert [i for w in fresh.split(t) for i in fresh.merge(w.encode())] == encoder.encode(t)


def test_frames(spark, encoder):
    rows = [(1, "hola", "x"), (2, None, "x"), (3, "", "x"), (3, "", "x"), (4, "palabra " * 20_000, "x")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = bpe.encode(frame).orderBy("doc_id").collect()
    assert [r["doc_id"] for r in got] == [1, 2, 3, 3, 4] and got[0]["ids"] == encoder.encode("hola") and [r["ids"] for r in got[1:4]] == [[], [], []]
    assert encoder.decode(got[4]["ids"]) == "palabra " * 20_000
    assert bpe.encode(frame.limit(0)).count() == 0
    sizes = {r["doc_id"]: r["n_tokens"] for r in bpe.count_tokens(frame, "text", ("doc_id",)).collect()}
    assert sizes[2] == 0 and sizes[1] == len(encoder.encode("hola"))


def test_apportionment():
    assert mixing.apportion({"a": 0.5, "b": 0.3, "c": 0.2}, 10) == {"a": 5, "b": 3, "c": 2}
    assert mixing.apportion({"a": 1.0, "b": 1.0}, 3) == {"a": 2, "b": 1}
    assert mixing.apportion({"a": 0.9, "b": 0.1}, 10, {"a": 2, "b": 5}) == {"a": 2, "b": 5}
    assert mixing.apportion({}, 5) == {} and mixing.apportion({"a": 0.0}, 5) == {"a": 0}
    r = random.Random(4)
    for _ in range(30):  # against block by block
        w = {f"s{i}": r.random() for i in range(6)}
        n, given = r.randrange(1, 200), dict.fromkeys(w := {f"s{i}": r.random() for i in range(6)}, 0)
        for _ in range(n):
            k = min(w, key=lambda s: (-w[s] / (2 * given[s] + 1), s))
            given[k] += 1
        assert mixing.apportion(w, n) == given


def test_a_large_source_among_small_ones():
    """Highest quotients, one after another, where the share alone would give the large one too much or too little."""
    weights = {"grande": 940.0, **{f"c{i:03}": 0.6 for i in range(100)}}
    given = dict.fromkeys(weights, 0)
    for _ in range(1000):
        given[min(weights, key=lambda s: (-weights[s] / (2 * given[s] + 1), s))] += 1
    assert mixing.apportion(weights, 1000) == given and given["grande"] == 900
    assert sum(mixing.apportion(weights, 10**9).values()) == 10**9
    equal = {f"s{i}": 1.0 for i in range(7)}
    assert mixing.apportion(equal, 10) == {f"s{i}": 1 + (i < 3) for i in range(7)}


def test_blocks_follow_the_shards(spark):
    """Far more tokens than blocks times shards: no part of a quota is lost, every share is met within a block."""
    rows = [(i, "ab"[i % 2], 10) for i in range(4000)]
    sized = spark.createDataFrame(rows, "doc_id long, source string, n_tokens int")
    targets = spark.createDataFrame([("a", 0.7, 2), ("b", 0.3, 1)], "source string, cuota double, max_repeticiones int")
    for shard_tokens in (100, 1000, 100_000):
        got = {x["source"]: x for x in mixing.mix(sized, targets, blocks=20, shard_tokens=shard_tokens)[1].collect()}
        assert got["a"]["tokens_mezcla"] + got["b"]["tokens_mezcla"] == pytest.approx(40_000, rel=0.02)
        assert got["a"]["cuota_real"] == pytest.approx(0.7, abs=0.01)


def test_mix(spark):
    r = random.Random(9)
    rows = [(i, ["Grande", "grande ", "chico", None, "otro"][i % 5 if i < 3000 else 0], r.randrange(1, 400), 1) for i in range(4000)] + [(1, "grande", 50, 1)] * 3 + [(9, "grande", None, 1), (10, "grande", 0, 1)]
    sized = spark.createDataFrame(rows, "doc_id long, source string, n_tokens int, cuota int")
    targets = spark.createDataFrame([("grande", 0.5, 1), ("chico", 0.5, 3), ("ninguno", 0.2, 2), (None, 0.1, 1)], "source string, cuota double, max_repeticiones int")
    records, report = mixing.mix(sized, targets, shard_tokens=20_000)
    got = {x["source"]: x for x in report.collect()}
    assert got["grande"]["cuota_real"] == pytest.approx(0.5, abs=0.01) and got["chico"]["cuota_real"] == pytest.approx(0.5, abs=0.01)
    assert got["ninguno"]["tokens_mezcla"] == 0 and got["chico"]["repeticion_maxima"] <= 3
    every = records.collect()
    assert all(x["repeticiones"] <= {"grande": 1, "chico": 3}[x["source"]] for x in every)
    assert sum(x["n_tokens"] * x["repeticiones"] for x in every if x["source"] == "chico") == got["chico"]["tokens_mezcla"]
    again = mixing.mix(sized, targets, shard_tokens=20_000)[0]
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, every))


def test_a_scarce_source_bounds_only_itself(spark):
    rows = [(i, "a", 100) for i in range(600)] + [(1000 + i, "b", 100) for i in range(200)] + [(2000, "c", 7)]
    sized = spark.createDataFrame(rows, "doc_id long, source string, n_tokens int")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.4, 2), ("c", 0.1, 2)], "source string, cuota double, max_repeticiones int")
    records, report = mixing.mix(sized, targets, shard_tokens=20_000)
    got = {x["source"]: x for x in report.collect()}
    assert got["c"]["tokens_mezcla"] == 14 and got["c"]["repeticion_maxima"] == 2  # all there is, less than a block or not
    assert got["a"]["tokens_mezcla"] == pytest.approx(0.5 * 80_007, abs=300)
    assert got["b"]["tokens_mezcla"] == pytest.approx(0.4 * 80_007, abs=300) and got["b"]["repeticion_maxima"] == 2
    assert sum(x["cuota_real"] for x in got.values()) == pytest.approx(1)
    few = {x["source"]: x for x in mixing.mix(sized, targets, blocks=10)[1].collect()}
    assert few["c"]["tokens_mezcla"] == 14
    once = targets.selectExpr("source", "cuota", "1 as max_repeticiones")  # shares are kept where nothing may repeat
    alone = {x["source"]: x["tokens_mezcla"] for x in mixing.mix(sized, once)[1].collect()}
    assert alone["a"] == pytest.approx(0.5 * 80_007, abs=300) and alone["b"] == 20_000 and alone["c"] == 7


def test_mix_of_nothing(spark):
    sized = spark.createDataFrame([], "doc_id long, source string, n_tokens int")
    targets = spark.createDataFrame([("a", 1.0, 1)], "source string, cuota double, max_repeticiones int")
    records, report = mixing.mix(sized, targets)
    assert records.count() == 0 and report.collect()[0]["cuota_real"] == 0
    assert mixing.mix(sized, targets.limit(0))[0].count() == 0
