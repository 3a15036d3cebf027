"""Language identification by words first, then shorter and shorter n-grams.

A model holds log frequencies per language of words and of the 4-, 3-, 2- and
1-grams of words. A known word scores by its own frequencies; an unseen one by
its longest n-grams that the model knows. A text's languages are weighed by
the sum over its words.

The fit reads at most about ``fit_rows`` labelled documents (chosen by a hash of
doc_id, whole texts) and keeps every word and n-gram met in them, so the model's
size is bounded by that sample whatever the table holds.

A null text, or one without a letter, is ``und`` with score 0. Without any
labelled row every text is ``und``. Languages that are equally likely go to the
name that sorts first. Repeated rows are scored alike. Very long
texts are read whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectide.llm.common import slices

LONGEST = 4
KEEP_WORDS = 300_000


def _words(texts: pa.LargeStringArray) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Codes of the letter runs of each text, the distinct runs, and row limits."""
    split = pc.split_pattern_regex(pc.utf8_lower(texts), r"[^\p{L}]+")
    flat = split.flatten().dictionary_encode()
    offsets = split.offsets.to_numpy().astype(np.int64)
    return flat.indices.to_numpy(zero_copy_only=False), flat.dictionary.to_pylist(), offsets - offsets[0]


def grams(word: str, n: int) -> list[str]:
    """The n-grams of a word between its marks; single letters go without marks."""
    marked = word if n == 1 else f"^{word}$"
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[tuple[str, int], Counter] = defaultdict(Counter)

    def out() -> pa.RecordBatch:
        rows = [(lang, n, gram, k) for (lang, n), c in found.items() for gram, k in c.items()]
        found.clear()
        return pa.RecordBatch.from_pydict({k: [r[i] for r in rows] for i, k in enumerate(("lang", "n", "gram", "k"))}, schema=pa.schema([("lang", pa.string()), ("n", pa.int32()), ("gram", pa.string()), ("k", pa.int64())]))

    for part in slices(batches, "text"):
        codes, words, limits = _words(part.column("text"))
        langs = np.array(part.column("lang").to_pylist(), dtype=object)
        rows = np.repeat(np.arange(part.num_rows), np.diff(limits))
        for lang in set(langs):
            for code, k in zip(*np.unique(codes[langs[rows] == lang], return_counts=True)):
                if word := words[code]:
                    found[lang, 0][word] += int(k)
                    for n in range(1, LONGEST + 1):
                        for gram in grams(word, n):
                            found[lang, n][gram] += int(k)
        if sum(map(len, found.values())) > 2_000_000:
            yield out()
    yield out()


def fit(docs: DataFrame, fit_rows: int = 20_000) -> dict:
    """The model of documents with columns doc_id, text and lang (rows with nulls are left out)."""
    docs = docs.where("text is not null and lang is not null").select(F.col("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = docs.count()
    if rows > fit_rows:
        docs = docs.where(F.pmod(F.xxhash64(F.lit("fit"), "doc_id"), F.lit(1 << 30)) < int((1 << 30) * fit_rows / rows))
    counts = docs.select("text", "lang").mapInArrow(_tally, "lang string, n int, gram string, k long").groupBy("lang", "n", "gram").agg(F.sum("k").alias("k"))
    got = counts.toArrow()
    langs = sorted(pc.unique(got.column("lang")).to_pylist())
    model: dict = {"langs": langs, "tables": []}
    for n in range(LONGEST + 1):
        own = got.filter(pc.equal(got.column("n"), n))
        coded = own.column("gram").combine_chunks().dictionary_encode()
        names, table = coded.dictionary.to_pylist(), np.zeros((len(coded.dictionary), len(langs)))
        if len(own):
            lang = pc.index_in(own.column("lang").combine_chunks(), value_set=pa.array(langs, pa.string()))
            table[coded.indices.to_numpy(), lang.to_numpy()] = own.column("k").to_numpy()
            total = table.sum(axis=0)
            table = np.log((table + 0.5) / (total + 0.5 * len(names)))
        model["tables"].append((names, table))
    return model


_loaded: dict[str, tuple] = {}


def _lookups(model: Broadcast, key: str) -> tuple:
    """The model's tables as dictionaries, and the words met so far, kept a worker."""
    if key not in _loaded:
        _loaded.clear()
        tables = [(dict(zip(names.split("\n"), range(n))), table) for names, n, table in model.value["tables"]]
        _loaded[key] = (model.value["langs"], tables, {})
    return _loaded[key]


def word_score(word: str, tables: list, n_langs: int) -> np.ndarray:
    """A word's log frequency in each language, or that of its longest known n-grams."""
    index, table = tables[0]
    if (i := index.get(word)) is not None:
        return table[i]
    for n in range(LONGEST, 0, -1):
        index, table = tables[n]
        if known := [i for g in grams(word, n) if (i := index.get(g)) is not None]:
            return table[known].mean(axis=0)
    return np.zeros(n_langs)


def _predict(batches: Iterator[pa.RecordBatch], model: Broadcast, key: str) -> Iterator[pa.RecordBatch]:
    langs, tables, known = _lookups(model, key)
    for part in slices(batches, "text"):
        codes, words, limits = _words(part.column("text"))
        if len(known) > KEEP_WORDS:
            known.clear()
        for w in words:
            if w and w not in known:
                known[w] = word_score(w, tables, len(langs))
        zero = np.zeros(len(langs))
        each = np.array([known[w] if w else zero for w in words]).reshape(len(words), len(langs))
        filled = np.array([w != "" for w in words], dtype=bool)
        sums = np.concatenate([np.zeros((1, len(langs))), np.cumsum(each[codes], axis=0)])
        total = sums[limits[1:]] - sums[limits[:-1]]
        seen = np.concatenate([[0], np.cumsum(filled[codes])])
        has = (seen[limits[1:]] > seen[limits[:-1]]) & bool(langs)
        best = total.argmax(axis=1) if langs else np.zeros(part.num_rows, int)
        score = np.zeros(part.num_rows)
        if langs:
            score = 1 / np.exp(np.clip(total - total.max(axis=1, keepdims=True), -700, 0)).sum(axis=1)
        yield pa.RecordBatch.from_arrays(
            [part.column("doc_id"), pa.array([langs[b] if h else "und" for b, h in zip(best, has)], pa.string()), pa.array(np.where(has, score, 0.0))],
            names=["doc_id", "lang_pred", "score"],
        )


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """``(doc_id, lang_pred, score)``: the likeliest language and its share of the weight."""
    sent = {"langs": model["langs"], "tables": [("\n".join(names), len(names), table.astype(np.float32)) for names, table in model["tables"]]}
    shared = docs.sparkSession.sparkContext.broadcast(sent)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(partial(_predict, model=shared, key=uuid.uuid4().hex), "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame, fit_rows: int = 20_000) -> DataFrame:
    """Learn from three quarters of the labelled documents, by hash; predict all."""
    held_out = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2
    model = fit(docs.where(~held_out), fit_rows)
    return predict(docs, model).withColumn("held_out", held_out).select("doc_id", "held_out", "lang_pred", "score")
