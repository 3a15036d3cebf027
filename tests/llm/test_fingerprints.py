import hashlib
import random

from brute import groups, shingles
from vectide.llm.fingerprints import digests, near_groups


def edited(texts):
    order = sorted(texts, reverse=True)
    nexts = {d: order[(i + 1) % len(order)] for i, d in enumerate(order)}
    t = {d: x or "" for d, x in texts.items()}
    return {d: t[d][: len(t[d]) - len(t[d]) // 3] + t[nexts[d]][: len(t[d]) // 3] for d in order}, nexts


def test_digests_follow_their_definition(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    texts |= {10_001: None, 10_002: "", 10_003: "é" * 7, 10_004: "two words"}
    docs = spark.createDataFrame([(d, t, 1) for d, t in texts.items()], "doc_id long, text string, bucket int").repartition(5)
    got = {r.doc_id: r for r in digests(docs).collect()}
    want, nexts = edited(texts)
    assert set(got) == set(texts)
    for d, r in got.items():
        assert r.n_chars == len(texts[d] or "")
        assert r.edited_sha256 == hashlib.sha256(want[d].encode()).hexdigest()
        a, b, c = shingles(texts[d]), shingles(want[d]), shingles(texts[nexts[d]])
        true = len(a & b) / len(a | b) if a | b else 1.0
        assert abs(r.near_edited - true) < 0.25
        assert abs(r.near_next - (len(a & c) / len(a | c) if a | c else 1.0)) < 0.25
        assert (texts[d] or "") != want[d] or r.fingerprint == r.edited_fingerprint


def test_one_row_and_none(spark):
    one = digests(spark.createDataFrame([(1, "abc def ghi")], "doc_id long, text string")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert digests(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_bands_find_the_near_groups(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want, _ = groups({r.doc_id: r.text for r in docs.collect()}, 80)
    found = {r.id: r.component for r in near_groups(docs).collect()}
    linked = {d: c for d, c in want.items() if list(want.values()).count(c) > 1}
    assert found == linked


def test_pairs_whose_bands_are_led_by_others(spark):
    rng = random.Random(5)
    common = [f"common{i}" for i in range(56)]
    rows = [(d, " ".join(rng.sample(common, 47) + [f"own{d}x{i}" for i in range(10)])) for d in range(60)]
    rows += [(100, " ".join(common + ["p", "q", "r", "s"])), (101, " ".join(common + ["t", "u", "v", "w"]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.id: r.component for r in near_groups(docs, width=1).collect()} == {100: 100, 101: 100}


def test_every_row_gives_one_row_whatever_repeats(spark):
    rng = random.Random(2)
    rows = []
    for d in range(120):
        text = " ".join(str(rng.randrange(50)) for _ in range(30))
        rows += [(d, text)] * (1 + d % 3) + [(d, text + " more")] * (d % 2) + [(None, text)] * (d % 5 == 0)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = digests(docs).collect()
    order = sorted(got, key=lambda r: (r.doc_id is None, -(r.doc_id or 0)))
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_chars) for r in got) == sorted((d is None, d or 0, len(t)) for d, t in rows)
    # within a doc_id rows go by length, so the next document of each is known
    texts = {(d, len(t)): t for d, t in rows if d is not None}
    line = [texts[k] for k in sorted(((r.doc_id, r.n_chars) for r in order if r.doc_id is not None), key=lambda k: (-k[0], k[1]))]
    want = {hashlib.sha256((x[: len(x) - len(x) // 3] + y[: len(x) // 3]).encode()).hexdigest() for x, y in zip(line, line[1:])}
    assert want <= {r.edited_sha256 for r in got}


def test_groups_of_the_query_are_verified_links(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want, _ = groups({r.doc_id: r.text for r in docs.collect()}, 80)
    assert {r.doc_id: r.near_group for r in digests(docs).collect()} == want


def test_texts_of_one_doc_id_are_one_document(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(3, a), (5, a + " z"), (5, b), (7, b + " z"), (9, c), (None, a)]
    got = near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.id: r.component for r in got} == {3: 3, 5: 3, 7: 3}


def test_groups_leave_no_texts_behind(spark, sf):
    from pathlib import Path

    from vectide.llm.common import work_dir

    folder = Path(work_dir(spark).removeprefix("file://"))
    before = set(folder.iterdir())
    groups = near_groups(spark.read.parquet(f"{sf}/documents.parquet"))
    left = [spark.read.parquet(f"file://{p}").columns for p in set(folder.iterdir()) - before]
    assert not [c for c in left if {"text", "band", "bands", "linked", "path"} & set(c)]
    assert groups.count() > 0


def test_texts_that_move_compressed_come_back_whole():
    import pyarrow as pa

    from vectide.llm.fingerprints import _packed, _restored

    texts = ["plain words", None, "", "é\x00ñ 漢字\n" * 3, "long " * 500_000, "after"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(6), pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "text"])
    got = [r for b in _restored(_packed(iter([batch]))) for r in b.to_pylist()]
    assert [(r["id"], r["text"]) for r in got] == [(i, t or "") for i, t in enumerate(texts)]
