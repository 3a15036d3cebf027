from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from vectide.llm.token_counts import PrefixCounts, default_path, longest_prefix, prefix_counts, processor, token_counts, tokens_of_prefix

import pyarrow as pa
import pytest

ODD = ["", " ", "  ", "\n", " \n", "\n\n", "a b", "a  b", " a", "a ", "a\n b", "a \nb", "a▁b", "▁", "<s>a</s>", "日本 語", "\ta\tb", "x\r\ny", "<unk>", "\x00a", "é a b", "a   \n   b   ", "▁▁▁▁▁▁▁▁▁▁▁▁▁▁▁▁▁▁▁▁x", " " * 40]


def exact(text):
    return len(processor(default_path()).encode(text))


def table(*texts):
    counts, limits = prefix_counts(pa.array(texts, pa.large_string()), default_path())
    return [counts[a:b].tolist() for a, b in zip(limits, limits[1:])]


def test_counts_and_tables_equal_the_library(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame([(10_000 + i, t) for i, t in enumerate([None, *ODD])], "doc_id long, text string"))
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    rows = token_counts(docs, limit=500, prefixes=True).collect()
    assert len(rows) == len(texts)
    for r in rows:
        t = texts[r.doc_id]
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(t.encode()), exact(t), exact(t) > 500)
        assert len(r.prefix_counts) == len(t) and (not t or r.prefix_counts[-1] == r.n_tokens)
        some = range(0, len(t), 1 if len(t) < 300 else 97)
        assert [r.prefix_counts[i] for i in some] == [exact(t[: i + 1]) for i in some]
        assert r.fitting_chars == max((i + 1 for i, n in enumerate(r.prefix_counts) if n <= 500), default=0)
    assert token_counts(docs.limit(0)).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab e\n\t▁éß0<s>/日")), max_size=25))
def test_every_prefix_of_any_text(text):
    assert table(text, "x", text) == [want := [exact(text[: i + 1]) for i in range(len(text))], [exact("x")], want]


@pytest.mark.parametrize("word", ["thentionreading", "unbelievable!!", "日本語", "eauouonéè", "24be64439e3e", "aaaaaaaa"])
def test_every_inner_prefix(word):
    assert PrefixCounts(default_path()).units(["▁", "▁" + word, "▁" + word[:3] + "x"])[1][1:] == [exact(word[: i + 1]) for i in range(len(word))]


def test_budgets_and_truncation_from_the_stored_table(spark):
    texts = ["one two\nthree  four", "", None, "   padded    text  "]
    stored = token_counts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), prefixes=True)
    for budget in (0, 1, 3, 5, 100):
        for r in stored.select("doc_id", longest_prefix(F.col("prefix_counts"), budget).alias("chars")).collect():
            t = texts[r.doc_id] or ""
            assert r.chars == max((i for i in range(len(t) + 1) if exact(t[:i]) <= budget), default=0)
    for chars in (0, 2, 9, 500):
        for r in stored.select("doc_id", tokens_of_prefix(F.col("prefix_counts"), chars).alias("n")).collect():
            assert r.n == exact((texts[r.doc_id] or "")[:chars])


def test_repeated_rows_clashing_columns_and_long_texts(spark):
    long = "word and  more\n" * 60_000
    rows = [(1, long, 5, "x"), (1, long, 5, "x"), (2, "a b", 6, "y"), (None, "a b", 7, "z")]
    got = token_counts(spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, n_bytes string")).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in got) == [(0, exact("a b")), (1, exact(long)), (1, exact(long)), (2, exact("a b"))]
