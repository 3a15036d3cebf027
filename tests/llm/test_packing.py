import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from vectide.llm.common import slices
from vectide.llm.packing import UnitIds, default_path, pack, plan, tokenizer


def whole(text):
    return tokenizer(default_path()).encode(text or "", add_special_tokens=False).ids + [1]


ODD = ["", " ", " x\u0085y", "<|endoftext|> a<|startoftext|>b", "don't CAN'T", "é ́x", "ΑΣ ΑΣΑ", "a\x0bb\x1cc", "日本 語 12345", "z " * 9000]


def test_pieces_places_and_ids(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame([(10_000 + i, t) for i, t in enumerate([None, *ODD])], "doc_id long, text string")).repartition(3)
    texts = {r.doc_id: r.text for r in docs.collect()}
    by_doc, by_sequence, tokens = defaultdict(list), defaultdict(list), 0
    for r in pack(docs).collect():
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    assert set(by_doc) == set(texts)
    for d, rows in by_doc.items():
        ids = whole(texts[d])
        tokens += len(ids)
        rows.sort(key=lambda r: r.piece)
        assert [(r.start, r.length) for r in rows] == [(s, min(4096, len(ids) - s)) for s in range(0, len(ids), 4096)]
        for r in rows:
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], dtype="<u4").tobytes())
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(by_sequence) <= 1.05 * tokens / 4096 + 1


@pytest.mark.parametrize("kind", ["small", "mid", "large", "mixed", "equal"])
def test_plans_are_whole_and_tight(kind):
    rng = np.random.default_rng(4)
    draw = {"small": (1, 400), "mid": (600, 1500), "large": (1500, 4096), "mixed": (1, 4097), "equal": (1300, 1301)}[kind]
    lengths, counts = np.unique(rng.integers(*draw, 30_000), return_counts=True)
    histogram = dict(zip(lengths.tolist(), counts.tolist()))
    made = plan(histogram)
    used, load = defaultdict(list), defaultdict(list)
    for length, rank, count, first, per, offset in made.placed:
        used[length] += range(rank, rank + count)
        for k in range(count):
            load[first + k // per].append((offset + k % per * length, length))
    assert {s: sorted(u) for s, u in used.items()} == {s: list(range(n)) for s, n in histogram.items()}
    for places in load.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096
    decreasing = best_fit_decreasing(histogram)
    assert len(load) == made.sequences <= decreasing


def best_fit_decreasing(histogram, capacity=4096):
    from bisect import bisect_left, insort

    rooms, bins = [], 0
    for s in sorted(histogram, reverse=True):
        for _ in range(histogram[s]):
            i = bisect_left(rooms, s)
            if i == len(rooms):
                bins += 1
                room = capacity
            else:
                room = rooms.pop(i)
            insort(rooms, room - s)
    return bins


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("abSİΣſßé'’.,!|<>0²ªǅ e\n\u0301\u0085st")), max_size=20))
def test_units_have_the_ids_of_the_text(text):
    ids, limits = UnitIds(default_path()).of(pa.array([text, "x."], pa.large_string()), 1)
    assert ids[: limits[1]].tolist() == whole(text)


def test_every_simple_sign_has_the_ids_of_the_text():
    texts = [f"a{c}B 1{c}{c}' {c}s x{c}'T {c}" for c in map(chr, range(0x21, 0x250))]
    ids, limits = UnitIds(default_path()).of(pa.array(texts, pa.large_string()), 1)
    assert [ids[a:b].tolist() for a, b in zip(limits, limits[1:])] == [whole(t) for t in texts]


def test_a_part_is_merged_once_and_nothing_is_kept(monkeypatch):
    met = []
    real = UnitIds.parts
    monkeypatch.setattr(UnitIds, "parts", lambda self, parts: met.append(sorted(parts.to_pylist())) or real(self, parts))
    units = UnitIds(default_path())
    before = dict(vars(units))
    text = "Word word, word. WORD! isn't (word) 7word"
    for _ in range(2):
        ids, _ = units.of(pa.array([text, None, text], pa.large_string()).fill_null(""), 1)
        assert ids.tolist() == whole(text) + [1] + whole(text)
    assert met == [sorted(["word", ",", ".", "!", "isn", "'t", "(", ")", "7"])] * 2
    assert vars(units) == before


def test_a_worker_gives_free_memory_back(monkeypatch):
    given, real = [], pa.default_memory_pool()

    class Pool:
        def release_unused(self):
            given.append(True)
            real.release_unused()

    batches = [pa.RecordBatch.from_pydict({"text": ["ab", None, "c" * 9]})] * 2
    monkeypatch.setattr(pa, "default_memory_pool", Pool)
    assert [b.column("text").to_pylist() for b in slices(iter(batches), "text", 4)] == [["ab", ""], ["c" * 9]] * 2
    assert given == [True]


def test_empty_table(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_missing_ids_repeated_rows_and_clashing_columns(spark):
    rows = [(None, "one two three", 1, "x", 0, 5), (None, "one two three", 2, "y", 0, 5), (None, None, 3, "z", 0, 5), (7, "", 4, None, 0, 5), (7, "four " * 5000, 5, "x", 0, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length int, piece string, sequence_id int, n int")
    got = pack(docs).select("doc_id", "piece", "start", "length", "sequence_id", "offset").collect()
    want = sorted((str(d), len(whole(t))) for d, t, *_ in rows)
    sums = {}
    for r in got:
        sums.setdefault((str(r.doc_id), r.piece), []).append(r.length)
    flat = sorted((d, n) for (d, p), ns in sums.items() if p == 0 and d == "None" for n in ns)
    assert flat == [w for w in want if w[0] == "None"]
    assert sum(r.length for r in got) == sum(n for _, n in want)
    filled = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == filled.get(r.sequence_id, 0)
        filled[r.sequence_id] = r.offset + r.length
    assert max(filled.values()) <= 4096
