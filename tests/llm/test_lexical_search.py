import math
import random
from collections import Counter

from vectide.llm import lexical_search
from vectide.llm.terms import words

DOCS, ITEMS = "doc_id long, text string, score int, terms string, m int", "item_id long, text string, rank int, item string"


def brute(docs, items, k):
    own = [(d, Counter(w.decode() for w in words((t or "").encode()))) for d, t in docs]
    own = [(d, c) for d, c in own if c]
    n, length = len(own), sum(sum(c.values()) for _, c in own)
    df = Counter(t for _, c in own for t in c)
    out = []
    for item_id, text in items:
        found = []
        for doc_id, counts in own:
            m = 50 + (50 * sum(counts.values()) * n) // length
            score = 0
            for t in {w.decode() for w in words((text or "").encode())}:
                if counts[t]:
                    score += math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * counts[t] // (1000 * counts[t] + 20 * m))
            if score > 0:
                found.append((-score, doc_id is None, doc_id, score))
        out += [(item_id, r, f[2], f[3]) for r, f in enumerate(sorted(found, key=lambda f: (f[0], f[1], f[2] or 0))[:k], 1)]
    return sorted(out, key=str)


def frames(spark, docs, items):
    return spark.createDataFrame([(d, t, 1, "x", 2) for d, t in docs], DOCS).repartition(4), spark.createDataFrame([(i, t, 1, "x") for i, t in items], ITEMS)


def corpus(rng, n):
    vocabulary = [f"w{i}" for i in range(400)] + ["日本", "Straße", "x"]
    heavy = [1 / (1 + i) for i in range(len(vocabulary))]
    docs = [(i, " ".join(rng.choices(vocabulary, heavy, k=rng.choice([1, 3, 30, 200])))) for i in range(n)]
    return vocabulary, docs


def test_against_brute_force(spark):
    rng = random.Random(2)
    vocabulary, docs = corpus(rng, 400)
    docs += [(900, None), (901, ""), (902, "!?"), (903, " ".join(rng.choices(vocabulary, k=40_000))), (904, "w1 " * 300 + "w2 " * 256), (None, "w7 w8"), (7, docs[9][1]), (7, docs[9][1])]
    items = [(i, " ".join(rng.sample(vocabulary, rng.choice([1, 3, 20])))) for i in range(20)] + [(50, None), (51, ""), (52, "unknownword"), (53, "W1 w1, w2?"), (53, "W1 w1, w2?"), (None, "w7")]
    got = lexical_search.search(*frames(spark, docs, items), k=10)
    assert sorted((tuple(r) for r in got.select("item_id", "rank", "doc_id", "score").collect()), key=str) == brute(docs, items, 10)


def test_blocks_seeds_and_ties(spark, monkeypatch):
    """Several blocks of queries, few seed rows, and hundreds of equal documents."""
    monkeypatch.setattr(lexical_search, "BLOCK_TERMS", 20)
    monkeypatch.setattr(lexical_search, "SEED_ROWS", 100)
    rng = random.Random(3)
    vocabulary, docs = corpus(rng, 300)
    docs += [(1000 + i, "w3 w5 w9") for i in range(300)]
    rng.shuffle(docs)
    items = [(i, " ".join(rng.sample(vocabulary, 6))) for i in range(15)] + [(99, "w5 w9")]
    got = lexical_search.search(*frames(spark, docs, items), k=20)
    assert sorted((tuple(r) for r in got.select("item_id", "rank", "doc_id", "score").collect()), key=str) == brute(docs, items, 20)


def test_bounds_save_most_of_the_work(spark):
    _, docs = corpus(random.Random(5), 3000)
    rare = frames(spark, docs, [(i, f"w{300 + i} w{350 + i}") for i in range(20)])
    assert lexical_search.rescored_share(*rare, k=10) < 0.3


def test_empty_tables(spark):
    docs, items = frames(spark, [(1, "a b")], [(1, "a")])
    assert lexical_search.search(docs.limit(0), items).count() == 0
    assert lexical_search.search(docs, items.limit(0)).count() == 0
    assert [tuple(r) for r in lexical_search.search(docs, items).select("item_id", "rank", "doc_id").collect()] == [(1, 1, 1)]
