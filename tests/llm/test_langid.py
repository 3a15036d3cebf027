import zlib

from vectide.llm.langid import fit, grams, identify, predict, word_score

def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.collect()}
    got = {r.doc_id: r for r in identify(docs).collect()}
    assert set(got) == set(truth)
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 4 == 2) for d, r in got.items())
    held = [d for d in truth if got[d].held_out and truth[d]]
    assert sum(got[d].lang_pred == truth[d] for d in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values())


def test_backs_off_to_shorter_grams(spark):
    rows = [(1, "the cat sat", "en"), (2, "die katze saß", "de"), (3, None, "xx"), (4, "nothing", None)]
    model = fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model["langs"] == ["de", "en"]
    tables = [(dict(zip(names, range(len(names)))), table) for names, table in model["tables"]]
    assert word_score("cat", tables, 2).argmax() == 1
    assert word_score("katzen", tables, 2).argmax() == 0
    assert word_score("ß", tables, 2).argmax() == 0
    assert word_score("漢", tables, 2).tolist() == [0, 0]
    assert grams("ab", 3) == ["^ab", "ab$"] and grams("ab", 1) == ["a", "b"]
    texts = [(1, None), (2, ""), (3, "123 !!"), (4, "THE CAT"), (5, "katze " * 30_000), (6, "漢字")]
    got = {r.doc_id: r for r in predict(spark.createDataFrame(texts, "doc_id long, text string"), model).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3, 4, 5)] == ["und", "und", "und", "en", "de"]
    assert got[1].score == 0 and got[6].lang_pred in model["langs"]


def test_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "a b", None), (2, None, None)], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in identify(docs).collect()} == {"und"}
    assert identify(docs.limit(0)).count() == 0


def test_predictions_equal_brute_force(spark, sf):
    import math
    from collections import Counter, defaultdict

    import regex

    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    counts = defaultdict(Counter)
    for r in rows:
        if r.lang and r.text is not None and zlib.crc32(str(r.doc_id).encode()) % 4 != 2:
            for w in regex.findall(r"\p{L}+", r.text.lower()):
                counts[r.lang, 0][w] += 1
                for n in range(1, 5):
                    counts[r.lang, n].update(grams(w, n))
    langs = sorted({lang for lang, _ in counts})
    known = [set().union(*(counts[lang, n] for lang in langs)) for n in range(5)]
    total = {k: sum(c.values()) for k, c in counts.items()}
    log = lambda lang, n, g: math.log((counts[lang, n][g] + 0.5) / (total[lang, n] + 0.5 * len(known[n])))

    def score(w, lang):
        if w in known[0]:
            return log(lang, 0, w)
        for n in range(4, 0, -1):
            if have := [g for g in grams(w, n) if g in known[n]]:
                return sum(log(lang, n, g) for g in have) / len(have)
        return 0.0

    got = {r.doc_id: r for r in identify(spark.read.parquet(f"{sf}/documents.parquet")).collect()}
    for r in rows:
        words = Counter(regex.findall(r"\p{L}+", (r.text or "").lower()))
        if not words:
            assert (got[r.doc_id].lang_pred, got[r.doc_id].score) == ("und", 0)
            continue
        sums = [sum(k * score(w, lang) for w, k in words.items()) for lang in langs]
        best = max(range(len(langs)), key=lambda i: sums[i])
        assert got[r.doc_id].lang_pred == langs[best]
        assert abs(got[r.doc_id].score - 1 / sum(math.exp(max(x - sums[best], -700)) for x in sums)) < 1e-2


def test_repeated_rows_and_clashing_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumnsRenamed({"source": "gram", "n_chars": "n"})
    one = {r.doc_id: (r.lang_pred, r.score) for r in identify(docs.unionByName(docs)).collect()}
    assert len(one) == docs.count()
    tie = fit(spark.createDataFrame([(1, "abc", "b"), (2, "abc", "a")], "doc_id long, text string, lang string"))
    assert predict(spark.createDataFrame([(1, "abc")], "doc_id long, text string"), tie).first().lang_pred == "a"
