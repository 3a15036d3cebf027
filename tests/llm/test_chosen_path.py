import random

from brute import groups
from vectide.llm.chosen_path import near_duplicates

SCHEMA = "doc_id long, text string, id long, path string, size int"


def check(spark, texts, percent=85, **tree):
    docs = spark.createDataFrame([(d, t, 0, "x", 1) for d, t in texts.items()], SCHEMA)
    got = {r.doc_id: r for r in near_duplicates(docs, percent, **tree).collect()}
    want, sets = groups(texts, percent)
    assert {d: r.component_id for d, r in got.items()} == want
    assert {d: r.n_shingles for d, r in got.items()} == {d: len(s) for d, s in sets.items()}
    assert all(r.kept == (d == r.component_id) for d, r in got.items())


def test_edges_nulls_ties_and_long_texts(spark):
    rng = random.Random(3)
    long = " ".join(str(rng.randrange(10**6)) for _ in range(30_000))
    texts = {1: None, 2: "", 3: " \t\n", 4: "one two", 5: "ONE  two\n", 6: "one", 7: long, 8: long + " more", 9: "a b c d e", 10: "É b c d e", 11: "é b c d e"}
    check(spark, texts)


def test_chains_and_groups(spark):
    rng = random.Random(5)
    texts, n = {}, 0
    for g in range(12):
        words = [str(rng.randrange(10**6)) for _ in range(rng.choice([20, 80, 300]))]
        for _ in range(rng.choice([1, 2, 5, 9])):
            n += 1
            texts[n] = " ".join(words)
            words = list(words)
            words[rng.randrange(len(words))] = "changed" + str(n)
    check(spark, texts)
    check(spark, texts, percent=80)


def test_a_large_node_still_finds_every_link(spark):
    rng = random.Random(9)
    base = [str(rng.randrange(10**6)) for _ in range(200)]
    texts = {}
    for n in range(90):  # all share a long part; pairs of neighbours are near
        if n % 3 == 0:
            words = base[:150] + [str(rng.randrange(10**6)) for _ in range(60)]
        texts[n] = " ".join(words[:-1] + [str(n)])
    check(spark, texts, small=4, depth=2)
    check(spark, texts, small=4, depth=1)


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
