from brute import groups

import corpus_pipeline
from vectide.llm import quality, secrets
from vectide.llm.common import table
from vectide.llm.packing import default_path, tokenizer
from vectide.llm.queries import ORACLES, QUERIES


def test_every_stage_against_its_own_input(spark, sf, tmp_path):
    docs = table(spark, sf, "documents")
    columns = docs.columns
    seen = []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r for r in docs.collect()}
        out = stage(spark, docs, sf)
        out.write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        after = docs.collect()
        seen.append(name)
        if i < 4:
            assert docs.columns == columns
            kept = {r.doc_id: r for r in after}
            assert len(kept) == len(after)
        if i == 0:
            verdict = {r.doc_id for r in quality.classify(table(spark, sf, "documents"), table(spark, sf, "labels")).where("predicted = 1").collect()}
            assert set(kept) == verdict and 0 < len(kept) < len(before)
        if i == 1:
            want, _ = groups({d: r.text for d, r in before.items()}, 80)
            assert set(kept) == set(want.values()) and len(kept) < len(before)
        if i == 2:
            passages = [r.text for r in table(spark, sf, "benchmark").collect()]
            assert set(kept) == {d for d, r in before.items() if not any(p in r.text for p in passages)}
            assert len(kept) < len(before)
        if i == 3:
            assert set(kept) == set(before)
            found = {r.doc_id: r.spans for r in secrets.scan(spark.createDataFrame(list(before.values()))).collect()}
            assert {d for d in kept if kept[d].text != before[d].text} == {d for d, s in found.items() if s}
            assert all(r.n_chars == len(r.text) for r in after if "[SECRET]" in r.text)
        if i == 4:
            want = {d: len(tokenizer(default_path()).encode(r.text, add_special_tokens=False).ids) + 1 for d, r in before.items()}
            got = {}
            for r in after:
                got[r.doc_id] = got.get(r.doc_id, 0) + r.length
            assert got == want
    assert len(seen) == 5


def test_empty_documents_pass_through(spark, sf):
    docs = table(spark, sf, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).count() == 0


def test_queries_are_registered():
    assert [int(n[2:].split("_")[0]) for n in QUERIES] == list(range(1, 11)) and not set(ORACLES) - set(QUERIES)


def test_rows_without_or_with_shared_ids(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    some = docs.orderBy("doc_id").limit(40)
    twice = spark.createDataFrame(docs.unionByName(some.selectExpr("cast(null as long) as doc_id", "text")).collect(), docs.schema)
    kept = corpus_pipeline.quality_stage(spark, twice, sf).collect()
    texts = {r.text for r in kept if r.doc_id is not None}
    assert sorted(r.text for r in kept if r.doc_id is None) == sorted(r.text for r in some.collect() if r.text in texts)
    assert 0 < sum(r.doc_id is None for r in kept) < 40

    prose = ["one two three four five six seven eight", "red green blue white black brown grey pink", "north south east west up down left right"]
    rows = [(None, prose[0]), (None, prose[1]), (5, prose[1]), (7, prose[2]), (7, prose[0] + " nine"), (9, "")]
    got = corpus_pipeline.near_dedup_stage(spark, spark.createDataFrame(rows, docs.schema), sf).collect()
    assert {(r.doc_id, r.text) for r in got} == {(5, prose[1]), (7, prose[2]), (7, prose[0] + " nine"), (9, "")}

    item = table(spark, sf, "benchmark").first().text
    rows = [(None, f"so {item} so"), (None, prose[0]), (3, item), (3, prose[1])]
    got = corpus_pipeline.decontaminate_stage(spark, spark.createDataFrame(rows, docs.schema), sf).collect()
    assert {(r.doc_id, r.text) for r in got} == {(None, prose[0]), (3, prose[1])}


def test_odd_rows_pass_every_stage(spark, sf):
    docs = table(spark, sf, "documents")
    first = docs.orderBy("doc_id").limit(3).collect()
    long = " ".join(f"plain{i % 977} words{i % 83}" for i in range(120_000))
    rows = [(None, None, "en", "s", 0), (90_001, None, None, None, None), (90_002, "", "en", "s", 0), (90_003, "", "en", "s", 0), (90_004, long, "en", "s", len(long)), (90_004, long, "en", "s", len(long))]
    odd = spark.createDataFrame([*rows, *first, *first], docs.schema)
    more = odd.withColumns({"tokens": odd.n_chars, "component_id": odd.lang, "spans": odd.source})
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, more, sf)
        got = out.collect()
        if k == 4:
            assert len({r.doc_id for r in got}) == 5 + len(first)
            continue
        assert out.columns == more.columns
        if k in (1, 2, 3):
            assert sum(r.text == long for r in got) == (1 if k == 1 else 2)
            assert {r.doc_id for r in got if not r.text} == {None, 90_001, 90_002, 90_003}
        if k == 1:
            assert len([r for r in got if r.doc_id == first[0].doc_id]) <= 1
