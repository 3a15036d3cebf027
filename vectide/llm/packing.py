"""Packing documents into sequences by linear grouping and best fit.

Documents are encoded once; only the length of a piece matters afterwards, and
a length is at most ``capacity``. The driver therefore plans on a histogram of
at most ``capacity`` rows, however many documents there are:

* large lengths are split into groups of equal cardinality and rounded up to
  the longest of their group;
* a linear program over configurations of a few group sizes is solved by
  column generation, and its whole part is taken;
* actual documents take the places of their group, from long to short;
* what is left over, and all small documents, goes by best fit.

Pieces are numbered within their length by counts per input part, so each one
finds its place in the plan without a sort or a gather of the rows.

A null text counts as empty: it has only the closing token. Rows without a doc_id
are packed like others, under a null doc_id. Repeated rows are packed each on its
own; pieces of one length take their places in the order they are read. Very long
texts are encoded whole and cut into pieces. An empty table gives an empty result.
Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache, partial
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vectide.llm.common import materialise, slices

#: Bytes of text that are encoded together: a word met in them again costs no merges.
ENCODED_BYTES = 4 << 20


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@lru_cache(maxsize=2)
def tokenizer(path: str):
    """The tokenizer at a path, loaded once a worker."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


#: How the tokenizer parts lower-cased text, and the units for which that is told by simple signs and letters alone.
PARTS = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
SIMPLE = r"^[\x21-\x7e\x{a1}-\x{12f}\x{131}-\x{17f}]+$"


def _byte_signs() -> str:
    """The visible sign that stands for each byte in a byte-level vocabulary; a space stays."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    signs = [chr(b) if b in plain else chr(next(other)) for b in range(256)]
    return "".join(" " if b == 32 else signs[b] for b in range(256))


BYTE_SIGNS = _byte_signs()


@lru_cache(maxsize=2)
def merges(path: str):
    """The tokenizer's merges alone, for parts between spaces, and which ids end a part."""
    from tokenizers import Tokenizer, pre_tokenizers

    full = tokenizer(path)
    alone = Tokenizer(full.model)
    alone.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    ends = np.zeros(full.get_vocab_size(), dtype=bool)
    ends[[i for t, i in full.get_vocab().items() if t.endswith("</w>")]] = True
    return alone, ends


def _spread(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The runs of ``flat`` that begin at ``start``, one behind the other."""
    total = np.cumsum(size)
    source = np.repeat(start - total + size, size)
    source += np.arange(len(source))
    return flat[source]


class UnitIds:
    """Ids of the space-free units of texts, those of a slice at a time.

    The tokenizer drops white space and never joins over it, so the ids of a
    text are those of its units in order. Units of simple letters, digits and
    signs are parted by the tokenizer's own pattern, and each different part goes
    to its merges, all in one text; some ids only end parts, which tells the
    parts' ids from each other. Other units go to the tokenizer whole, each by
    itself. Nothing is kept from slice to slice.
    """

    def __init__(self, path: str):
        self.path = path

    def parts(self, parts: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
        """All parts' ids, and their limits."""
        alone, ends = merges(self.path)
        text = " ".join(parts.to_numpy(zero_copy_only=False)).encode().decode("latin-1").translate(BYTE_SIGNS)
        ids = np.array(alone.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=np.uint32)
        return ids, np.concatenate([[0], np.flatnonzero(ends[ids]) + 1])

    def encode(self, units: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All units' ids in one array, and where each unit starts and how many it has."""
        simple = pc.and_not(pc.match_substring_regex(units, SIMPLE), pc.match_substring(units, "<|"))
        split = pc.ascii_split_whitespace(pc.ascii_rtrim(pc.replace_substring_regex(pc.utf8_lower(units.filter(simple)), PARTS, r"\0 "), " "))
        coded = split.flatten().dictionary_encode()
        ids, limits = self.parts(coded.dictionary)
        codes, offsets = coded.indices.to_numpy(zero_copy_only=False), split.offsets.to_numpy()
        sizes = np.diff(limits)[codes]
        bounds = np.concatenate([[0], np.cumsum(sizes)])[offsets - offsets[0]]
        others = [e.ids for e in tokenizer(self.path).encode_batch_fast(units.filter(pc.invert(simple)).to_pylist(), add_special_tokens=False)]
        fast = simple.to_numpy(zero_copy_only=False)
        start, size = np.zeros(len(units), dtype=np.int64), np.zeros(len(units), dtype=np.int64)
        start[fast], size[fast] = bounds[:-1], np.diff(bounds)
        size[~fast] = [len(x) for x in others]
        start[~fast] = bounds[-1] + np.cumsum(size[~fast]) - size[~fast]
        return np.concatenate([_spread(ids, limits[codes], sizes), np.fromiter(chain.from_iterable(others), dtype=np.uint32)]), start, size

    def of(self, texts: pa.LargeStringArray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids, each closed by ``end``, and their limits."""
        split = pc.ascii_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False)
        flat, start, size = self.encode(coded.dictionary)
        offsets = split.offsets.to_numpy().astype(np.int64)
        offsets -= offsets[0]
        limits = np.concatenate([[0], np.cumsum(size[codes])])[offsets] + np.arange(len(offsets))
        out = np.full(limits[-1], end, dtype=np.uint32)
        filled = np.ones(len(out), dtype=bool)
        filled[limits[1:] - 1] = False
        out[filled] = _spread(flat, start[codes], size[codes])
        return out, limits


def _pieces(batches: Iterator[pa.RecordBatch], path: str, capacity: int, end: int) -> Iterator[pa.RecordBatch]:
    units = UnitIds(path)
    part_id, met = TaskContext.get().partitionId(), defaultdict(int)
    for part in slices(batches, "text", ENCODED_BYTES):
        ids, limits = units.of(part.column("text"), end)
        rows = []
        for doc, a, b in zip(part.column("doc_id").to_pylist(), limits, limits[1:]):
            for k, s in enumerate(range(a, b, capacity)):
                e = min(b, s + capacity)
                rows.append((doc, k, s - a, e - s, zlib.crc32(ids[s:e].astype("<u4").tobytes()), part_id, met[e - s]))
                met[e - s] += 1
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()))],
            names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"],
        )


def pieces(docs: DataFrame, path: str | None = None, capacity: int = 4096, end: int = 1) -> DataFrame:
    """The pieces of every document, with their number among equal lengths of a part."""
    thin = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return thin.mapInArrow(partial(_pieces, path=path or default_path(), capacity=capacity, end=end), "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long")


def best_configuration(sizes: list[int], worth: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The configuration of sizes with the greatest worth that fits (a bounded knapsack)."""
    best = np.zeros(capacity + 1)
    taken = []
    for s, w in zip(sizes, worth):
        for _ in range(capacity // s if w > 1e-12 else 0):
            with_it = best[:-s] + w
            better = with_it > best[s:] + 1e-12
            if not better.any():
                break
            taken.append((s, better))
            best[s:] = np.where(better, with_it, best[s:])
    room, counts, place = int(best.argmax()), np.zeros(len(sizes)), {s: i for i, s in enumerate(sizes)}
    for s, better in reversed(taken):
        if room >= s and better[room - s]:
            counts[place[s]] += 1
            room -= s
    return float(best.max()), counts


def configurations(sizes: list[int], demand: list[int], capacity: int, steps: int = 3000) -> list[tuple[np.ndarray, float]]:
    """Configurations and how often the linear program uses each, by column generation."""
    k = len(sizes)
    columns = [np.eye(k)[i] * (capacity // sizes[i]) for i in range(k)]
    inverse = np.diag([1 / (capacity // s) for s in sizes])
    for _ in range(steps):
        worth = inverse.sum(axis=0)
        value, column = best_configuration(sizes, worth, capacity)
        if value <= 1 + 1e-7:
            break
        x, d = inverse @ np.asarray(demand, dtype=float), inverse @ column
        ratio = np.where(d > 1e-9, x / np.where(d > 1e-9, d, 1), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        columns[out] = column
        inverse[out] /= d[out]
        d[out] = 0
        inverse -= np.outer(d, inverse[out])
    return list(zip(columns, np.maximum(inverse @ np.asarray(demand, dtype=float), 0)))


class Plan:
    """Sequences being filled, as runs of alike sequences; and where lengths go."""

    def __init__(self, capacity: int):
        self.capacity, self.sequences = capacity, 0
        self.placed: list[tuple[int, int, int, int, int, int]] = []  # length, rank, count, sequence, per sequence, offset
        self.room: dict[int, list[tuple[int, int]]] = defaultdict(list)  # residual: (first sequence, count)
        self.residuals: list[int] = []

    def open(self, count: int) -> tuple[int, int]:
        self.sequences += count
        return self.sequences - count, count

    def keep(self, residual: int, run: tuple[int, int]) -> None:
        if residual and run[1]:
            if not self.room[residual]:
                insort(self.residuals, residual)
            self.room[residual].append(run)

    def put(self, length: int, rank: int, run: tuple[int, int], residual: int, count: int) -> None:
        """Fill a run with ``count`` items, as many a sequence as fit one by one."""
        q = residual // length
        first, n = run
        whole, rest = divmod(count, q)
        self.placed.append((length, rank, count, first, q, self.capacity - residual))
        self.keep(residual - q * length, (first, whole))
        if rest:
            self.keep(residual - rest * length, (first + whole, 1))
        used = whole + (rest > 0)
        self.keep(residual, (first + used, n - used))

    def best_fit(self, length: int, rank: int, count: int) -> None:
        while count:
            at = bisect_left(self.residuals, length)
            if at == len(self.residuals):
                self.put(length, rank, self.open(-(-count // (self.capacity // length))), self.capacity, count)
                return
            residual = self.residuals[at]
            run = self.room[residual].pop()
            if not self.room[residual]:
                self.residuals.pop(at)
            n = min(count, run[1] * (residual // length))
            self.put(length, rank, run, residual, n)
            rank, count = rank + n, count - n


#: (groups, share): lengths above capacity / share are large and go through grouping.
#: In the last only lengths over half the capacity are, one to a sequence; more is left to best fit.
SCHEMES = ((24, 4), (12, 6), (64, 8), (24, 2))


def plan(histogram: dict[int, int], capacity: int = 4096, schemes: tuple[tuple[int, int], ...] = SCHEMES) -> Plan:
    """Places for ``histogram[length]`` pieces of each length.

    More groups round less and leave more over, and small documents fill what
    rounding wastes; the first grouping that needs the fewest sequences is taken.
    """
    return min((_grouped(histogram, capacity, *scheme) for scheme in schemes), key=lambda p: p.sequences)


def _grouped(histogram: dict[int, int], capacity: int, groups: int, large: int) -> Plan:
    out = Plan(capacity)
    if n := histogram.get(capacity):
        out.placed.append((capacity, 0, n, out.open(n)[0], 1, 0))
    least = capacity // large
    big = sorted((s for s in histogram if least < s < capacity), reverse=True)
    total = sum(histogram[s] for s in big)
    queues: list[list[list[int]]] = []  # of each group: [length, first rank, count], long to short
    if total:
        each, left = -(-total // min(groups, total)), 0
        for s in big:
            have = histogram[s]
            while have:
                if not left:
                    queues.append([])
                    left = each
                n = min(have, left)
                queues[-1].append([s, histogram[s] - have, n])
                have, left = have - n, left - n
    sizes, joined = [], []
    for q in queues:  # groups of one and the same size are one
        if sizes and sizes[-1] == q[0][0]:
            joined[-1] += q
        else:
            sizes.append(q[0][0])
            joined.append(q)
    demand = [sum(n for _, _, n in q) for q in joined]
    for column, times in configurations(sizes, demand, capacity) if sizes else []:
        copies = int(times + 1e-9)
        if not copies:
            continue
        runs = [(*out.open(copies), capacity)]
        for g in np.repeat(np.arange(len(sizes)), column.astype(int)):
            filled = []
            for first, n, residual in runs:
                while n and joined[g]:
                    length, at, have = joined[g][0]
                    m = min(n, have)
                    out.placed.append((length, at, m, first, 1, capacity - residual))
                    filled.append((first, m, residual - length))
                    first, n = first + m, n - m
                    joined[g][0] = [length, at + m, have - m]
                    if have == m:
                        joined[g].pop(0)
                if n:
                    filled.append((first, n, residual))
            runs = filled
        for first, n, residual in runs:
            out.keep(residual, (first, n))
    rest: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for q in joined:
        for length, at, n in q:
            rest[length].append((at, n))
    for s in histogram:
        if s <= least and s < capacity:
            rest[s].append((0, histogram[s]))
    for length in sorted(rest, reverse=True):
        for at, n in rest[length]:
            out.best_fit(length, at, n)
    return out


def _place(batches: Iterator[pa.RecordBatch], ranges: dict) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        length, nth = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("length", "rank"))
        at = np.searchsorted(ranges["key"], length * ranges["span"] + nth, side="right") - 1
        k = nth - ranges["rank"][at]
        sequence = ranges["sequence"][at] + k // ranges["per"][at]
        offset = ranges["offset"][at] + k % ranges["per"][at] * length
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])


def pack(docs: DataFrame, path: str | None = None, capacity: int = 4096, end: int = 1) -> DataFrame:
    """Every piece's sequence and place in it; see the module's text."""
    cut = materialise(pieces(docs, path, capacity, end))
    per_part = cut.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = per_part.select("length", "part", before.alias("before"))
    histogram = {r.length: r.n for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    made = sorted(plan(histogram, capacity).placed)
    span = max(histogram.values(), default=0) + 1
    columns = np.array(made, dtype=np.int64).reshape(-1, 6).T
    ranges = {"key": columns[0] * span + columns[1], "span": span, "rank": columns[1], "sequence": columns[3], "per": columns[4], "offset": columns[5]}
    ranked = cut.join(offsets, ["length", "part"]).withColumn("rank", F.col("nth") + F.col("before"))
    return ranked.mapInArrow(partial(_place, ranges=ranges), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
