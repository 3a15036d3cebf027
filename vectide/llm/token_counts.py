"""Exact token counts at every prefix, without encoding a text again.

The count at a prefix follows from shorter ones by dynamic programming. For a
byte-fallback BPE a sequence of pieces is an encoding if and only if every two
neighbours are one, so the encoding of a prefix ends in the one piece that is
stable beside the last piece of what is before it:
``count[end] = count[start of that piece] + 1``.

Pieces never hold a space behind another sign, nor a line end, so a text falls
into units (a run of spaces and the word behind it, or a line end and the word
behind it) that are encoded apart from each other. Each distinct unit's counts
are found once, in alphabetical order, so that units that begin alike share
what they begin with. A text's table is the running sum over its units: one
number for each sign of the text. Its last entry is the text's token count; how
long a prefix fits into a budget, or what a truncated text costs, is read off
the table.

Null texts count as empty, with 0 tokens. Runs of spaces, leading and trailing
ones and the library's own space sign are units like others. Repeated rows are
counted each on its own, rows without a doc_id like others. An empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, partial
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectide.llm.common import slices, utf8

SPACE = "▁"
KEEP_UNITS = 1_000_000
KEEP_PAIRS = 1_000_000
#: Stands for no piece.
NONE = (1 << 20) - 1


@lru_cache(maxsize=2)
def processor(path: str):
    """The sentencepiece model at a path, loaded once a worker."""
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class PrefixCounts:
    """Counts at every prefix of units, by dynamic programming over pieces."""

    def __init__(self, path: str):
        self.model = processor(path)
        m = self.model
        self.pieces = {m.id_to_piece(i): i for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))}
        # the longest piece with these last three signs
        self.longest: dict[str, int] = {}
        for piece in self.pieces:
            self.longest[piece[-3:]] = max(self.longest.get(piece[-3:], 0), len(piece))
        self.pairs: dict[int, bool] = {}
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.flat = np.zeros(0, dtype=np.int32)
        self.start = np.zeros(1, dtype=np.int64)

    def stable(self, before: int, piece: int) -> bool:
        """Whether two pieces, written side by side, are encoded as just these; with NONE before, whether the piece is."""
        names = [self.model.id_to_piece(p) for p in (before, piece) if p != NONE]
        signs = "".join(names)
        if signs == SPACE:
            return True
        lead = signs[0] == SPACE
        got = self.model.encode(signs[1:] if lead else "\n" + signs, out_type=str, num_threads=1)
        return (got if lead else got[2:]) == names

    def units(self, units: list[str]) -> list[list[int]]:
        """Exact tokens of every non-empty prefix of each unit, spaces written as the space sign."""
        piece_of, pairs, longest = self.pieces.get, self.pairs, self.longest.get
        out: list[list[int]] = [[]] * len(units)
        last, count, done = [NONE], [0], ""
        for i in sorted(range(len(units)), key=units.__getitem__):
            signs = units[i]
            same, most = 0, min(len(signs), len(done))
            while same < most and signs[same] == done[same]:
                same += 1
            del last[same + 1 :], count[same + 1 :]
            for end in range(same + 1, len(signs) + 1):
                first = end - longest(signs[end - 3 if end > 3 else 0 : end], 2)
                for start in range(first if first > 0 else 0, end):
                    piece = piece_of(signs[start:end])
                    if piece is not None:
                        pair = last[start] << 20 | piece
                        fits = pairs.get(pair)
                        if fits is None:
                            fits = pairs[pair] = self.stable(last[start], piece)
                        if fits:
                            last.append(piece)
                            count.append(count[start] + 1)
                            break
                else:  # a sign of no piece is spelt in bytes, which join nothing
                    last.append(NONE)
                    count.append(count[end - 1] + len(signs[end - 1].encode()))
            out[i], done = count[1:], signs
        if len(pairs) > KEEP_PAIRS:
            pairs.clear()
        return out

    def places(self, units: list[str]) -> np.ndarray:
        """The place of each unit's counts, ``flat[start[place] : start[place + 1]]``."""
        if len(self.place) > KEEP_UNITS:
            self.clear()
        new = [u for u in units if u not in self.place]
        if new:
            counts = self.units(new)
            self.place.update(zip(new, range(len(self.place), len(self.place) + len(new))))
            sizes = np.fromiter(map(len, counts), dtype=np.int64, count=len(counts))
            self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(counts), dtype=np.int32, count=int(sizes.sum()))])
            self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(sizes)])
        return np.fromiter((self.place[u] for u in units), dtype=np.int64, count=len(units))


_tables: dict[str, PrefixCounts] = {}


def prefix_counts(texts: pa.LargeStringArray, path: str) -> tuple[np.ndarray, np.ndarray]:
    """The token counts at every non-empty prefix of each text, end to end, and the texts' limits in them."""
    spaced = pc.replace_substring(pc.replace_substring(texts, SPACE, " "), "\n", " \n")
    split = pc.split_pattern(spaced, " ")
    flat = split.flatten().dictionary_encode()
    codes, words = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64), flat.dictionary.to_pylist()
    offsets = split.offsets.to_numpy().astype(np.int64)
    offsets -= offsets[0]
    n, rows = len(codes), len(offsets) - 1
    # a blank between splits is one more space before the next word; before a line end or a text's end it is a unit's own
    blank, lined = (np.array([f(w) for w in words], dtype=bool)[codes] for f in (lambda w: w == "", lambda w: w[:1] == "\n"))
    order, last = np.arange(n), np.zeros(n + 1, dtype=bool)
    last[offsets[1:]] = True
    before = np.concatenate([[-1], np.maximum.accumulate(np.where(blank, -1, order))[:-1]]) if n else order
    before = order - np.maximum(before + 1, np.repeat(offsets[:-1], np.diff(offsets)))
    spaces = np.where(last[1:] & blank, before + 1, np.where(lined, before, 0))
    # units in order: of each split at most a run of spaces and a word
    has_run, has_word = spaces > 0, ~blank
    where = np.concatenate([2 * order[has_run], 2 * order[has_word] + 1])
    kind = np.concatenate([-spaces[has_run], np.where(lined, 0, before)[has_word] * len(words) + codes[has_word]])
    into = np.argsort(where, kind="stable")
    where, kind = where[into], kind[into]
    distinct, code = np.unique(kind, return_inverse=True)
    units = [SPACE * -k if k < 0 else ("" if words[k % len(words)][0] == "\n" else SPACE * (k // len(words) + 1)) + words[k % len(words)] for k in distinct.tolist()]
    if path not in _tables:
        _tables[path] = PrefixCounts(path)
    table = _tables[path]
    place = table.places(units)
    at, size = table.start[place][code], (table.start[place + 1] - table.start[place])[code]
    cost = table.flat[at + size - 1].astype(np.int64)
    owner = np.searchsorted(offsets, where // 2, side="right") - 1
    first = np.ones(len(owner), dtype=bool)
    first[1:] = owner[1:] != owner[:-1]
    total = np.concatenate([[0], np.cumsum(cost)])
    base = total[:-1] - total[:-1][np.maximum.accumulate(np.where(first, np.arange(len(owner)), 0))]
    # the first unit begins with a space that is not in the text
    skip = first.astype(np.int64)
    length = size - skip
    limits = np.concatenate([[0], np.cumsum(np.bincount(owner, weights=length, minlength=rows).astype(np.int64))])
    ends = np.cumsum(length)
    source = np.repeat(at + skip - (ends - length), length) + np.arange(ends[-1] if len(ends) else 0)
    return np.repeat(base, length) + table.flat[source], limits


def _count(batches: Iterator[pa.RecordBatch], path: str, limit: int, prefixes: bool) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "text"):
        texts = part.column("text")
        counts, limits = prefix_counts(texts, path)
        full = np.diff(limits) > 0
        total = np.zeros(len(full), dtype=np.int64)
        total[full] = counts[limits[1:][full] - 1]
        fitting = np.diff(limits)
        for i in np.flatnonzero(total > limit):
            within = np.flatnonzero(counts[limits[i] : limits[i + 1]] <= limit)
            fitting[i] = within[-1] + 1 if len(within) else 0
        columns = [part.column("doc_id"), pa.array(np.diff(utf8(texts)[1])), pa.array(total), pa.array(total > limit), pa.array(fitting)]
        if prefixes:
            columns.append(pa.ListArray.from_arrays(pa.array(limits.astype(np.int32)), pa.array(counts.astype(np.int32))))
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "n_tokens", "over_limit", "fitting_chars", "prefix_counts"][: len(columns)])


def token_counts(docs: DataFrame, path: str | None = None, limit: int = 4096, prefixes: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit and fitting_chars, and on request prefix_counts.

    prefix_counts holds the tokens of every non-empty prefix of the text, a
    number for each code point. fitting_chars is the length of the longest
    prefix of at most ``limit`` tokens.
    """
    schema = "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fitting_chars long" + ", prefix_counts array<int>" * prefixes
    thin = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return thin.mapInArrow(partial(_count, path=path or default_path(), limit=limit, prefixes=prefixes), schema)


def tokens_of_prefix(counts: Column, chars: Column | int) -> Column:
    """The tokens of a text cut after ``chars`` code points, from its stored table."""
    chars = F.lit(chars) if isinstance(chars, int) else chars
    return F.when(chars < 1, F.lit(0)).otherwise(F.coalesce(F.get(counts, F.least(chars, F.size(counts)) - 1), F.lit(0)))


def longest_prefix(counts: Column, budget: Column | int) -> Column:
    """The code points of the longest prefix of at most ``budget`` tokens, from a text's stored table.

    Longer prefixes may have fewer tokens, so the last one that fits counts.
    """
    fits = F.transform(counts, lambda n: n <= budget)
    return F.coalesce(F.array_max(F.transform(fits, lambda ok, i: F.when(ok, i + 1))), F.lit(0))
