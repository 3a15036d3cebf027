import hashlib
import random
import re

from vectide.llm import content_sort

SCHEMA = "doc_id long, text string, norm string, hash long, part int, size long"


def brute(rows):
    """(doc_id, keep_id, group_size, kept, text_sha256) of each row, from the definition."""
    groups = {}
    for n, (doc_id, text) in enumerate(rows):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text or ""), []).append((-len(text or ""), doc_id is None, doc_id, n))
    out = []
    for norm, own in groups.items():
        first = min(own, key=lambda r: (r[0], r[1], r[2] or 0, r[3]))
        out += [(r[2], first[2], len(own), r is first, hashlib.sha256(norm.encode()).hexdigest()) for r in own]
    return sorted(out, key=str)


def check(spark, rows):
    docs = spark.createDataFrame([(d, t, "x", 1, 2, 3) for d, t in rows], SCHEMA).repartition(5)
    assert sorted((tuple(r) for r in content_sort.equal_texts(docs).collect()), key=str) == brute(rows)


def test_edges(spark):
    long = "long words " * 30_000
    check(spark, [(1, None), (2, ""), (3, " \t\n\x0b\x0c\r"), (4, "a b"), (5, "ab"), (6, "a\x0bb"), (7, "a\xa0b"), (8, long), (9, long.replace(" ", "  ")), (10, "A b"), (None, "ab"), (None, "a  b"), (12, "é\x85"), (13, "é \x85"), (14, "\U0001f600 a"), (15, "\U0001f600a")])


def test_repeated_rows_and_ties(spark):
    check(spark, [(7, "a b")] * 3 + [(None, "a b")] * 2 + [(3, "ab ")] * 2 + [(None, "no id")] * 3)


def test_hot_texts_are_split_and_stay_whole(spark):
    rng = random.Random(4)
    heads = ["the same beginning of many texts " + str(rng.random()) for _ in range(40)]
    rows = [(i, "hot " * 30 + " " * rng.randrange(3)) for i in range(900)]
    rows += [(1000 + i, rng.choice(heads) + " " * rng.randrange(2)) for i in range(900)]
    rows += [(None, "without an id") for _ in range(600)]
    rng.shuffle(rows)
    check(spark, rows)


def test_one_exchange_of_texts(spark, sf, monkeypatch):
    """The window runs on the ranges as they are dealt: no text moves twice."""
    plans = []
    monkeypatch.setattr(content_sort, "materialise", lambda df, keep=content_sort.materialise: plans.append(df._jdf.queryExecution().executedPlan().toString()) or keep(df))
    content_sort.equal_texts(spark.read.parquet(f"{sf}/documents.parquet")).collect()
    assert plans[1].count("Exchange rangepartitioning") == 1 and "Exchange hashpartitioning" not in plans[1]


def test_empty_table(spark):
    assert content_sort.equal_texts(spark.createDataFrame([], SCHEMA)).count() == 0
