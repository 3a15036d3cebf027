"""Removal of repeated byte strings by external induced suffix sorting.

Every byte that lies in a string of ``length`` bytes which also starts anywhere
else in the corpus goes. Only sample suffixes are sorted from their signs; the
others are induced, and common-prefix values are carried along:

1. Sampling. Each window of ``length`` bytes names the position of its least
   ``k``-gram hash. Equal windows name the same place, so a run of windows with
   one name is settled among the suffixes of that name alone. Texts leave
   about one sample suffix for 185 bytes.
2. Naming. Runs whose whole span is equal share a name, by count; a span met
   twice is repeated throughout and needs no sort. A name met once is clear.
3. Sorting. Spans still contested are moved by name and sorted by Spark by
   name and by their bytes from the sample place on: its sorted runs lie on disk
   and are merged through a priority queue, so a part may be far larger than
   memory. Names with too many spans are first split by windows, each half with
   the longer string its windows share, until they are small: no group meets
   whole in a task.
4. Induction. From the sample suffixes' order and common prefixes with their
   neighbours, the order of the suffixes one byte to the left follows from that
   byte and the order before it, and the common prefix is one more than the
   least value between the two; and so on to the first window of the run. A
   suffix alone in its bucket drops out. Windows with a common
   prefix of ``length`` are repeated.

Beside this, ``repeated_passages`` tells which documents hold a run of words
that another one holds too, whatever its length in bytes.

Null and short texts lose nothing. Each row is a document of its own, with or
without a doc_id: repeated rows are copies of each other, and other texts of one
doc_id have nothing to do with it. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectide.llm.common import discard, inverse, materialise, mix, powers, shingle_hashes, slices, utf8, word_hashes

GRAM = 32
#: A document longer than this is sampled piece by piece.
PIECE = 6 << 20
#: Spans of one name that are sorted together.
TOGETHER = 4096
_U = np.uint64
_BASE = 0xA24BAED4963EE407
_PLACE = (1 << 24) - 1

RUNS = "name long, span long, doc long, first long, windows int, reach int"


def sample(raw: np.ndarray, limits: np.ndarray, length: int, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Runs of windows with one sample suffix: name, span hash, row, first window, windows, reach.

    reach is how far the sample suffix starts behind the first window. At most
    2**24 bytes are taken at once.
    """
    n, width = len(raw), length - gram + 1
    if n < length:
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(6))
    total = np.zeros(n + 1, dtype=_U)
    np.cumsum((raw.astype(_U) + _U(1)) * powers(_BASE, n), out=total[1:])
    back = powers(inverse(_BASE), n)
    hashes = mix((total[gram:] - total[:-gram]) * back[: n - gram + 1])
    least = (hashes & ~_U(_PLACE)) | np.arange(len(hashes), dtype=_U)
    step, m = 1, len(hashes)
    while step * 2 <= width:
        m = len(least) - step
        least = np.minimum(least[:m], least[step : step + m])
        step *= 2
    if width > step:
        m = len(least) - (width - step)
        least = np.minimum(least[:m], least[width - step : width - step + m])
    at = (least & _U(_PLACE)).astype(np.int64)
    # windows that lie in one row
    edge = np.zeros(n + 1, dtype=np.int32)
    np.add.at(edge, limits[1:-1], 1)
    row = np.cumsum(edge[:n])
    whole = row[: len(at)] == row[length - 1 : length - 1 + len(at)]
    new = whole.copy()
    new[1:] &= (at[1:] != at[:-1]) | ~whole[:-1] | (row[1 : len(at)] != row[: len(at) - 1])
    starts = np.flatnonzero(new)
    stop = np.ones(len(at), dtype=bool)
    stop[:-1] = new[1:] | ~whole[1:]
    ends = np.flatnonzero(whole & stop)
    stops = ends + length
    span = mix((total[stops] - total[starts]) * back[starts] ^ ((stops - starts).astype(_U) * _U(0xD6E8FEB86659FD93)))
    places = at[starts]
    rows = np.searchsorted(limits, starts, side="right") - 1
    return hashes[places].view(np.int64), span.view(np.int64), rows, starts - limits[rows], ends - starts + 1, places - starts


def _runs(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "text"):
        raw, limits = utf8(part.column("text"))
        docs = part.column("doc").to_numpy(zero_copy_only=False)
        pieces = [(0, raw, limits)]
        if len(raw) > PIECE:  # one long text
            pieces = [(a, raw[a : a + PIECE + length - 1], np.array([0, len(raw[a : a + PIECE + length - 1])])) for a in range(0, len(raw) - length + 1, PIECE)]
        for shift, own, cuts in pieces:
            name, span, row, first, windows, reach = sample(own, cuts, length)
            yield pa.RecordBatch.from_arrays(
                [pa.array(name), pa.array(span), pa.array(docs[row], pa.int64()), pa.array(first + shift), pa.array(windows.astype(np.int32)), pa.array(reach.astype(np.int32))],
                names=["name", "span", "doc", "first", "windows", "reach"],
            )


def induce(groups: np.ndarray, contexts: list[bytes], reach: np.ndarray, windows: np.ndarray, length: int) -> np.ndarray:
    """Which windows of contested spans are repeated: a row for each span, a column for each window.

    contexts: the bytes of each span from its first window on; its sample
    suffix starts at ``reach``. Spans of one group share their name, and come in
    the order of their sample suffixes.
    """
    n, most = len(contexts), int(windows.max())
    out = np.zeros((n, most), dtype=bool)
    order = np.arange(n)
    right = np.zeros((n, length), dtype=np.int16)
    left = np.full((n, int(reach.max()) + 1), -1, dtype=np.int16)
    for j, i in enumerate(order):
        tail = np.frombuffer(contexts[i], dtype=np.uint8)
        own = tail[reach[i] : reach[i] + length]
        right[j, : len(own)] = own
        right[j, len(own) :] = -1 - j  # what a span does not hold equals nothing
        left[j, 1 : reach[i] + 1] = tail[: reach[i]][::-1]
    same = right[1:] == right[:-1]
    common = np.zeros(n, dtype=np.int64)
    common[1:] = np.where(same.all(axis=1), length, same.argmin(axis=1))
    del right, same
    segment = np.zeros(n, dtype=np.int64)
    segment[1:] = np.cumsum(groups[order[1:]] != groups[order[:-1]])
    row, far, some = np.arange(n), reach[order], windows[order]
    near = far - some + 1  # the offset of the last window
    for o in range(int(far.max()) + 1):
        if o:
            keep = far[row] >= o
            place = np.flatnonzero(keep)
            key = segment[place] * 256 + left[row[place], o]
            into = np.argsort(key, kind="stable")
            key, place = key[into], place[into]
            fresh = np.ones(len(key), dtype=bool)
            fresh[1:] = key[1:] != key[:-1]
            alone = fresh & np.append(fresh[1:], True)
            key, place = key[~alone], place[~alone]
            if not len(key):
                break
            fresh = np.ones(len(key), dtype=bool)
            fresh[1:] = key[1:] != key[:-1]
            common = np.where(fresh, 0, _least_between(common, np.append(0, place[:-1]), place, fresh) + 1)
            segment, row = np.cumsum(fresh) - 1, row[place]
        live = np.flatnonzero(near[row] <= o)
        if len(live) < 2:
            continue
        apart = np.ones(len(live), dtype=bool)
        apart[1:] = segment[live[1:]] != segment[live[:-1]]
        between = _least_between(common, np.append(0, live[:-1]), live, apart)
        hit = ~apart & (between >= length)
        dup = hit | np.append(hit[1:], False)
        who = row[live[dup]]
        out[order[who], far[who] - o] = True
    return out


def _least_between(values: np.ndarray, a: np.ndarray, b: np.ndarray, skip: np.ndarray) -> np.ndarray:
    """The least of ``values[a + 1 : b + 1]`` for each pair, where ``skip`` is not set."""
    low, high = np.where(skip, 0, a + 1), np.where(skip, 0, b)
    size = high - low + 1
    out = np.zeros(len(low), dtype=values.dtype)
    table, step = values, 1
    while True:
        now = (size >= step) & (size < 2 * step)
        out[now] = np.minimum(table[low[now]], table[high[now] - step + 1])
        if step * 2 > size.max():
            return out
        m = len(table) - step
        table = np.minimum(table[:m], table[step : step + m])
        step *= 2


def _cut(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """The bytes of the spans that are asked of each document."""
    for part in slices(batches, "text"):
        raw, limits = utf8(part.column("text"))
        asked, docs = part.column("asked"), part.column("doc").to_pylist()
        rows = []
        for i in range(part.num_rows):
            text = raw[limits[i] : limits[i + 1]]
            for q in asked[i].as_py():
                own = text[q["first"] : q["first"] + q["windows"] + length - 1].tobytes()
                rows.append((q["name"], docs[i], q["first"], q["windows"], q["reach"], q["copies"], own[: q["reach"]], own[q["reach"] :]))
                if len(rows) >= 4000:
                    yield _spans(rows)
                    rows = []
        if rows:
            yield _spans(rows)


SPANS = pa.schema([("name", pa.int64()), ("doc", pa.int64()), ("first", pa.int64()), ("windows", pa.int32()), ("reach", pa.int32()), ("copies", pa.int64()), ("head", pa.binary()), ("tail", pa.binary())])
SPANS_SQL = "name long, doc long, first long, windows int, reach int, copies long, head binary, tail binary"


def _spans(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(SPANS)], schema=SPANS)


def _halve(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Each span as two, of its nearer and its farther windows, named by what the windows share.

    Halves are cut by offset from the sample suffix, the same for all spans of
    a name and round; a part of one window keeps the window's own name.
    """
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            low, high = r["low"], r["high"]
            middle = (low + high) // 2
            for a, b in ((low, middle), (middle + 1, high)):
                # offsets a..b of windows, of those that the span has
                far, near = min(b, r["reach"]), max(a, r["reach"] - r["windows"] + 1)
                if far < near:
                    continue
                first = r["reach"] - far
                whole = r["head"] + r["tail"]
                text = whole[first : first + far - near + length]
                shared = whole[r["reach"] - a : r["reach"] - b + length] if b - a < length and r["reach"] >= a and r["reach"] - b + length <= len(whole) else b""
                name = int.from_bytes(hashlib.blake2b(shared + b"|%d|%d" % (a, b), digest_size=8, key=r["name"].to_bytes(8, "little", signed=True)).digest(), "little", signed=True)
                rows.append((name, r["doc"], r["first"] + first, far - near + 1, far, r["copies"], text[:far], text[far:], a, b))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], t) for i, t in enumerate([f.type for f in SPANS] + [pa.int32(), pa.int32()])], names=[f.name for f in SPANS] + ["low", "high"])


def _settle(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Repeated windows of sorted spans, a bounded number of names at a time."""
    held: list[dict] = []

    def flush(rows: list[dict]) -> pa.RecordBatch:
        names = np.array([r["name"] for r in rows])
        dup = induce(names, [r["head"] + r["tail"] for r in rows], np.array([r["reach"] for r in rows]), np.array([r["windows"] for r in rows]), length)
        found = []
        for r, d in zip(rows, dup):
            if r["copies"] > 1:
                continue  # repeated throughout, and told so elsewhere
            edges = np.flatnonzero(np.diff(np.concatenate([[0], d.view(np.int8), [0]])))
            found += [(r["doc"], r["first"] + int(a), r["first"] + int(b)) for a, b in zip(edges[::2], edges[1::2])]
        return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.int64()))], names=["doc", "start", "stop"])

    for batch in batches:
        held += batch.to_pylist()
        if len(held) > 2 * TOGETHER:  # keep the last name, which may go on
            cut = len(held)
            while cut and held[cut - 1]["name"] == held[-1]["name"]:
                cut -= 1
            for ready in _by_names(held[:cut]):
                yield flush(ready)
            held = held[cut:]
    for ready in _by_names(held):
        yield flush(ready)


def _by_names(rows: list[dict]) -> Iterator[list[dict]]:
    """Rows in lists of whole names, about ``TOGETHER`` long."""
    start = 0
    for i in range(1, len(rows) + 1):
        if i == len(rows) or (i - start >= TOGETHER and rows[i]["name"] != rows[i - 1]["name"]):
            yield rows[start:i]
            start = i


def _texts(docs: DataFrame) -> DataFrame:
    """doc, doc_id and text. doc is a row's own number: its doc_id where these tell rows apart, else one that is written with the row, so that it stays."""
    thin = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ids = thin.agg(F.count("*").alias("rows"), F.count_distinct("doc_id").alias("ids")).first()
    if ids.rows == ids.ids:
        return thin.withColumn("doc", F.col("doc_id"))
    return materialise(thin.withColumn("doc", F.monotonically_increasing_id()))


def _contested(thin: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """Ranges of windows that are repeated throughout, and by document the spans that need a sort."""
    runs = materialise(thin.where(F.octet_length("text") >= length).select("doc", "text").mapInArrow(partial(_runs, length=length), RUNS))
    # most names are met once, and need nothing more
    # written, so that the join below deals it out anew and can split a name that very many runs share
    often = materialise(runs.groupBy("name").agg(F.count("*").alias("n")).where("n > 1").select("name"))
    every, runs = runs, materialise(runs.join(often, "name"))
    discard(every, often)
    same = ["name", "span", "windows", "reach"]
    names = materialise(runs.groupBy(*same).agg(F.count("*").alias("copies"), F.min(F.struct("doc", "first")).alias("one")))
    shared = names.groupBy("name").agg(F.count("*").alias("spans"), F.min("copies").alias("least"))
    copied = runs.join(names.where("copies > 1").select(*same), same)
    whole = copied.select("doc", F.col("first").alias("start"), (F.col("first") + F.col("windows")).alias("stop"))
    contested = names.join(shared.where("spans > 1 and least = 1").select("name"), "name")
    asked = contested.groupBy(F.col("one.doc").alias("doc")).agg(F.collect_list(F.struct("name", F.col("one.first").alias("first"), "windows", "reach", "copies")).alias("asked"))
    whole, asked = materialise(whole), materialise(asked)
    discard(runs, names)
    return whole, asked


def _settled(texts: DataFrame, whole: DataFrame, asked: DataFrame, length: int, together: int) -> DataFrame:
    """All ranges of repeated windows, from the texts of the documents that are asked."""
    cut = materialise(texts.join(asked, "doc").select("doc", "text", "asked").mapInArrow(partial(_cut, length=length), SPANS_SQL).dropDuplicates(["name", "doc", "first", "windows"]))
    found = []
    cut = cut.withColumns({"low": F.lit(0), "high": F.lit(length - GRAM)})
    while True:
        sizes = cut.groupBy("name").agg(F.count("*").alias("spans"))
        crowded = materialise(sizes.where(F.col("spans") > together).select("name"))
        if crowded.isEmpty():
            found.append(cut)
            break
        found.append(cut.join(crowded, "name", "left_anti"))
        crowd = cut.join(crowded, "name")
        done = crowd.where("low = high").select("doc", F.col("first").alias("start"), (F.col("first") + 1).alias("stop"))
        whole = whole.unionByName(done)
        cut = materialise(crowd.where("low < high").mapInArrow(partial(_halve, length=length), SPANS_SQL + ", low int, high int"))
    columns = [f.name for f in SPANS]
    rest = found[0].select(*columns)
    for more in found[1:]:
        rest = rest.unionByName(more.select(*columns))
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rest.repartition(parts, "name").sortWithinPartitions("name", "tail")
    return whole.unionByName(ordered.mapInArrow(partial(_settle, length=length), "doc long, start long, stop long"))


def repeated_windows(docs: DataFrame, length: int = 400, together: int = TOGETHER) -> DataFrame:
    """``(doc, start, stop)``: the starts of repeated windows, as ranges in bytes."""
    thin = _texts(docs)
    return _settled(thin, *_contested(thin, length), length, together)


def _passages(batches: Iterator[pa.RecordBatch], words: int, width: int = 5) -> Iterator[pa.RecordBatch]:
    """Runs of windows of words, named by their least shingle: name, the hash of the whole run, and its first window."""
    for part in slices(batches, "text"):
        docs = part.column("doc").to_numpy(zero_copy_only=False)
        hashes, limits = word_hashes(part.column("text"))
        shingles, starts = shingle_hashes(part.column("text"), width)
        names, spans, owners, firsts, counts = [], [], [], [], []
        for i in np.flatnonzero(np.diff(limits) >= words):
            own, least = hashes[limits[i] : limits[i + 1]], shingles[starts[i] : starts[i + 1]]
            # of each window the place of its least shingle
            span, step = words - width + 1, 1
            low = (least & ~_U(_PLACE)) | np.arange(len(least), dtype=_U)
            while step * 2 <= span:
                low = np.minimum(low[:-step], low[step:])
                step *= 2
            if span > step:
                low = np.minimum(low[: step - span], low[span - step :])
            at = (low & _U(_PLACE)).astype(np.int64)
            first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
            stop = np.append(first[1:], len(at)) + words - 1
            total = np.concatenate([np.zeros(1, _U), np.cumsum((own + _U(1)) * powers(_BASE, len(own)), dtype=_U)])
            names.append(least[at[first]])
            spans.append(mix((total[stop] - total[first]) * powers(inverse(_BASE), len(own) + 1)[first] ^ ((stop - first).astype(_U) * _U(0xD6E8FEB86659FD93))))
            owners.append(np.full(len(first), i))
            firsts.append(first)
            counts.append(stop - first - words + 1)
        if names:
            row = np.concatenate(owners)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(names).view(np.int64)), pa.array(np.concatenate(spans).view(np.int64)), pa.array(docs[row]), pa.array(np.concatenate(firsts).astype(np.int32)), pa.array(np.concatenate(counts).astype(np.int32))],
                names=["name", "span", "doc", "first", "windows"],
            )


def _window_hashes(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    """The hash of each window of words that is asked of a document."""
    for part in slices(batches, "text"):
        docs = part.column("doc").to_numpy(zero_copy_only=False)
        hashes, limits = word_hashes(part.column("text"))
        for i, asked in enumerate(part.column("asked").to_pylist()):
            own = hashes[limits[i] : limits[i + 1]]
            total = np.concatenate([np.zeros(1, _U), np.cumsum((own + _U(1)) * powers(_BASE, len(own)), dtype=_U)])
            at = np.unique(np.concatenate([np.arange(q["first"], q["first"] + q["windows"]) for q in asked]))
            window = mix((total[at + words] - total[at]) * powers(inverse(_BASE), len(own) + 1)[at])
            yield pa.RecordBatch.from_arrays([pa.array(window.view(np.int64)), pa.array(np.full(len(at), docs[i]))], names=["window", "doc"])


def _open_passages(thin: DataFrame, words: int) -> tuple[DataFrame, DataFrame]:
    """Documents that share a whole run of windows, and by document the runs whose windows are to be compared one by one."""
    runs = materialise(thin.select("doc", "text").mapInArrow(partial(_passages, words=words), "name long, span long, doc long, first int, windows int"))
    ends = [F.min("doc").alias("a"), F.max("doc").alias("z")]
    often = materialise(runs.groupBy("name").agg(*ends).where("a <> z").select("name"))
    every, runs = runs, materialise(runs.join(often, "name"))
    discard(every, often)
    spans = materialise(runs.groupBy("name", "span").agg(*ends).select("name", "span", (F.col("a") != F.col("z")).alias("shared")))
    told = materialise(runs.join(spans, ["name", "span"]))
    discard(runs, spans)
    sure = materialise(told.where("shared").select("doc").distinct())
    open_ = told.where(~F.col("shared")).join(sure, "doc", "left_anti")
    # the other runs of a name, each once, are what an open run is compared with
    one = told.groupBy("name", "span").agg(F.min(F.struct("doc", "first", "windows")).alias("q"))
    others = one.join(open_.select("name").distinct(), "name", "left_semi").select("q.*")
    asked = open_.select("doc", "first", "windows").unionByName(others).distinct().groupBy("doc").agg(F.collect_list(F.struct("first", "windows")).alias("asked"))
    asked = materialise(asked)
    discard(told)
    return sure, asked


def _shared_passages(texts: DataFrame, sure: DataFrame, asked: DataFrame, words: int) -> DataFrame:
    windows = materialise(texts.join(asked, "doc").select("doc", "text", "asked").mapInArrow(partial(_window_hashes, words=words), "window long, doc long"))
    met = windows.groupBy("window").agg(F.min("doc").alias("a"), F.max("doc").alias("z")).where("a <> z")
    return sure.unionByName(windows.join(met.select("window"), "window").select("doc")).distinct()


def repeated_passages(docs: DataFrame, words: int = 50) -> DataFrame:
    """The doc_id of the documents that hold a run of ``words`` words which another document holds too.

    Words are those between white space, A-Z in lower case. Windows of words are
    named by their least shingle; runs that are equal under a name settle it,
    and only where they differ are single windows compared.
    """
    thin = _texts(docs)
    found = _shared_passages(thin, *_open_passages(thin, words), words)
    return thin.join(found, "doc", "left_semi").select("doc_id")


def _strip(batches: Iterator[pa.RecordBatch], length: int, keep_text: bool) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "text"):
        raw, limits = utf8(part.column("text"))
        ranges = part.column("ranges")
        removed, spans, digests, texts = [], [], [], []
        for i in range(part.num_rows):
            own = raw[limits[i] : limits[i + 1]]
            found = ranges[i].as_py()
            gone = spanned = 0
            if found:
                found.sort(key=lambda r: r["start"])
                kept, end = [], 0
                start = stop = -1
                for r in [*found, None]:
                    if r is not None and r["start"] <= stop:
                        stop = max(stop, r["stop"] + length - 1)
                        continue
                    if stop >= 0:
                        kept.append(own[end:start])
                        end, gone, spanned = stop, gone + stop - start, spanned + 1
                    if r is not None:
                        start, stop = r["start"], r["stop"] + length - 1
                kept.append(own[end:])
                own = np.concatenate(kept)
            removed.append(gone)
            spans.append(spanned)
            digests.append(hashlib.sha256(own).hexdigest())
            texts.append(own.tobytes() if keep_text else None)
        columns = [part.column("doc_id"), pa.array(np.diff(limits)), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests, pa.string()), part.column("repeats_passage")]
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "repeats_passage"]
        if keep_text:
            columns.append(pa.array(texts, pa.binary()))
            names.append("kept")
        yield pa.RecordBatch.from_arrays(columns, names=names)


def remove_repeats(docs: DataFrame, length: int = 400, together: int = TOGETHER, keep_text: bool = False, words: int = 50) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document; on request the kept bytes.

    repeats_passage says whether the document holds ``words`` words in a row that another one holds too.
    """
    thin = _texts(docs)
    whole, asked = _contested(thin, length)
    sure, runs = _open_passages(thin, words)
    # the texts that either needs are fetched once
    texts = materialise(thin.join(asked.select("doc").union(runs.select("doc")).distinct(), "doc", "left_semi"))
    ranges = _settled(texts, whole, asked, length, together).groupBy("doc").agg(F.collect_list(F.struct("start", "stop")).alias("ranges"))
    passages = _shared_passages(texts, sure, runs, words).withColumn("repeats_passage", F.lit(True))
    found = ranges.join(passages, "doc", "full")
    none = F.array().cast("array<struct<start:bigint,stop:bigint>>")
    both = thin.join(found, "doc", "left").withColumns({"ranges": F.coalesce("ranges", none), "repeats_passage": F.coalesce("repeats_passage", F.lit(False))})
    both = both.select("doc_id", "text", "ranges", "repeats_passage")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, repeats_passage boolean" + ", kept binary" * keep_text
    return both.mapInArrow(partial(_strip, length=length, keep_text=keep_text), schema)
