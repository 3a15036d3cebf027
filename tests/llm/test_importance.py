import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from vectide.llm import importance
from vectide.llm.terms import words

SCHEMA = "doc_id long, text string, weight string, score int, bucket double"


def tokens(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))


def grams(text, width):
    own = tokens(text)
    return [" ".join(own[i : i + n]) for n in range(1, width + 1) for i in range(len(own) - n + 1)]


def brute(docs, target, width, buckets, least=20, percent=10):
    at = lambda g: zlib.crc32(g.encode()) % buckets
    s, t = Counter(at(g) for _, x in docs for g in grams(x, width)), Counter(at(g) for x in target for g in grams(x, width))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in set(s) | set(t)}
    out = []
    for doc_id, text in docs:
        own = [gain[at(g)] for g in grams(text, width)]
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(own) // len(own) if own else 0
        out.append([doc_id, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    ranked = sorted((i for i, (_, x) in enumerate(docs) if len(tokens(x)) >= least), key=lambda i: (-out[i][3], out[i][0] is None, out[i][0] or 0))
    for rank, i in enumerate(ranked[: len(ranked) * percent // 100], 1):
        out[i][4] = rank
    return sorted(map(tuple, out), key=str)


def some(rng, n):
    return " ".join(rng.choice(["Wörter", "日本語", "abc", "the", "The", "x1", "a" * 70, "né", "it's", "word-break", "zz_z"]) for _ in range(n))


@pytest.mark.parametrize("width", [1, 3])
def test_against_brute_force(spark, width):
    rng = random.Random(width)
    docs = [(i, some(rng, rng.choice([0, 1, 5, 19, 20, 60]))) for i in range(150)]
    docs += [(900, None), (901, ""), (902, "!? .."), (903, some(rng, 20_000)), (None, some(rng, 30)), (None, some(rng, 30)), (5, docs[3][1])]
    target = [some(rng, 40), None, "the the the x1"]
    frame = spark.createDataFrame([(d, x, "w", 1, 0.5) for d, x in docs], SCHEMA).repartition(4)
    got = importance.resample(frame, spark.createDataFrame([(x, 3) for x in target], "text string, bucket int"), width=width, buckets=997, percent=50)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(docs, target, width, 997, percent=50)


def test_repeated_rows_are_ranked_one_by_one(spark):
    text = " ".join(map(str, range(30)))
    docs = spark.createDataFrame([(7, text, "w", 1, 0.5)] * 40 + [(None, text, "w", 1, 0.5)] * 60, SCHEMA).repartition(3)
    got = importance.resample(docs, docs, percent=30).collect()
    assert len(got) == 100 and sorted(r.rank for r in got if r.rank) == list(range(1, 31))


def test_crc_of_ngrams_from_prefixes():
    rng = random.Random(1)
    own = words(some(rng, 300).encode() + b" " + b"y" * 70_000)
    crcs, ends = importance.prefixes(own)
    for n in (1, 2, 3, 7):
        firsts = np.arange(len(own) - n + 1)
        assert importance.ngram_crcs(crcs, ends, firsts, n).tolist() == [zlib.crc32(b" ".join(own[i : i + n])) for i in firsts]


def test_words_follow_their_pattern():
    text = "".join(map(chr, range(300))) + " ÄÖ x-Y_z9"
    assert [w.decode() for w in words(text.encode())] == tokens(text)


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    one = spark.createDataFrame([(1, "a b", "w", 1, 0.5)], SCHEMA)
    assert importance.resample(none, one).count() == 0
    assert importance.resample(one, none).first().rank is None
