import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from vectide.llm.suffix_dedup import remove_repeats


def brute(texts, length):
    seen = Counter()
    raw = {d: (t or "").encode() for d, t in texts.items()}
    for b in raw.values():
        seen.update(b[i : i + length] for i in range(len(b) - length + 1))
    out = {}
    for d, b in raw.items():
        gone = np.zeros(len(b), dtype=bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        edges = np.count_nonzero(np.diff(np.concatenate([[0], gone.view(np.int8)])) == 1)
        out[d] = (len(b), int(gone.sum()), int(edges), hashlib.sha256(np.frombuffer(b, dtype=np.uint8)[~gone].tobytes()).hexdigest())
    return out


def check(spark, texts, length=400, **options):
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in remove_repeats(docs, length, **options).collect()}
    assert got == brute(texts, length)


def test_given_documents(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if len(r.text) < 8000}
    check(spark, texts)


@pytest.mark.parametrize("seed", range(4))
def test_edited_copies_and_shared_passages(spark, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randrange(1, 8)))
    line = lambda n: " ".join(word() for _ in range(n))
    shared, texts = [line(120) for _ in range(3)], {}
    for d in range(40):
        t = line(rng.randrange(5, 150))
        for s in rng.sample(shared, rng.randrange(3)):
            a = rng.randrange(0, 200)
            t = t + s[a : a + rng.randrange(100, 600)] + line(rng.randrange(40))
        for _ in range(rng.randrange(3)):
            i = rng.randrange(len(t))
            t = t[:i] + "#" + t[i + 1 :]
        texts[d] = t
    texts |= {100: texts[0], 101: texts[0], 102: None, 103: "", 104: "x" * 399, 105: "y" * 400, 106: "y" * 401, 107: "zw" * 600}
    check(spark, texts)
    check(spark, texts, together=3)


def test_empty_table(spark):
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("words", [50, 8])
def test_passages_of_words_that_others_hold(spark, sf, words):
    from collections import defaultdict

    from brute import LOWER, WORD
    from vectide.llm.suffix_dedup import repeated_passages

    rng = random.Random(words)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    shared = " ".join(str(rng.randrange(10**6)) for _ in range(90))
    for d in range(30):  # the same words, other white space
        cut = shared.split()[rng.randrange(60) :][: rng.randrange(45, 60)]
        texts[1000 + d] = " ".join(str(rng.randrange(10**6)) for _ in range(60)) + "\n " + "  ".join(cut)
    texts |= {2000: "same " * 300, 2001: "once " * 30, 2002: None, 2003: ""}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    owners = defaultdict(set)
    for d, t in texts.items():
        w = WORD.findall((t or "").translate(LOWER))
        for i in range(len(w) - words + 1):
            owners[tuple(w[i : i + words])].add(d)
    want = {d for ds in owners.values() if len(ds) > 1 for d in ds}
    assert {r.doc_id for r in repeated_passages(docs, words).collect()} == want and len(want) < len(texts)


def test_texts_of_one_doc_id_and_none(spark):
    rng = random.Random(1)
    a, b, c = ("".join(rng.choice("abcdefgh ") for _ in range(900)) for _ in range(3))
    rows = [(1, a, "x", 1), (1, b, "y", 2), (2, a, "z", 3), (None, c, "x", 4), (None, c, "x", 5), (3, b[:300], "", 6), (None, None, "", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, name string, first int")
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_removed, r.repeats_passage) for r in remove_repeats(docs).collect())
    assert [g[:3] for g in got] == sorted([(0, 0, 0), (0, 900, 900), (0, 900, 900), (1, 900, 0), (1, 900, 900), (2, 900, 900), (3, 300, 0)])


def test_a_very_long_text(spark):
    rng = random.Random(8)
    long = "".join(rng.choice("abcdefghij ") for _ in range(7_000_000))
    rows = [(1, long), (2, "z" * 500 + long[6_290_000:6_293_000] + "q" * 300)]
    got = {r.doc_id: r for r in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1].n_bytes, got[1].n_removed, got[1].n_spans) == (7_000_000, 3000, 1) and got[2].n_removed == 500 + 3000


def test_texts_without_a_doc_id_whose_hashes_collide(spark):
    from pyspark.sql import functions as F

    texts = spark.range(300_000).select(F.concat(F.lit("x"), F.sha2(F.col("id").cast("string"), 512), F.sha2(F.concat(F.lit("-"), "id"), 512), F.sha2(F.concat(F.lit("+"), "id"), 512), F.sha2(F.concat(F.lit("*"), "id"), 512)).alias("t"))
    a, b = texts.groupBy(F.hash("t")).agg(F.min("t").alias("a"), F.max("t").alias("b")).where("a <> b").select("a", "b").first()
    rows = [(None, a), (None, b), (3, "y" * 10 + a[20:470]), (3, "other")]
    got = sorted((r.n_bytes, r.n_removed) for r in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted([(513, 450), (513, 0), (460, 450), (5, 0)])
