"""Benchmark decontamination by template windows, with DataFrame functions only.

Texts become templates: numbers (in figures or in English words), names
(capitalised words) and units turn into typed placeholders that keep their value
beside them. A capital at the start of a sentence may be a name or not, so an
item's windows come in both forms; in documents it counts as a name, and words
in lower case as words.
Windows of eight template tokens are joined by hash with those of the
benchmark. Every window holds a run of five tokens that starts at a multiple of
four in the document; windows whose run the benchmark has nowhere are passed
over, as their templates cannot be equal. A document holds an item if at least half of the item's windows meet
at one alignment, or at neighbouring ones (a quarter of the item apart at most,
so words may be added or dropped), or if a run of thirty tokens meets at one
alignment. Inside the windows that meet, each slot value of the item must stand
for one value of the document: so a question with other numbers is caught, and
a chance meeting of templates whose slots contradict each other is not.

Items of fewer than eight tokens are one window of their own length. Windows
with fewer than four plain words (all, if shorter) are common as templates and
are hashed with their values, so a verbatim item is always held. Null and empty
texts hold nothing; null or empty items are never held, and of items with one
item_id the last text in order counts. Very long texts are read whole. Rows are
judged by doc_id and text, null doc_ids like others; a repeated row gives its
matches once, and all items that a document holds are told, whatever their
coverage's order. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectide.llm.common import materialise

WIDTH = 8
LITERALS = 4
SHARE = 0.5
RUN = 30
#: What may stand before an item and change its first token: a word makes it a name, a number a unit.
BEFORE = ("a ", "1 ")
#: Benchmarks of at most so many windows are sent to every executor (16 bytes and a few numbers each).
BROADCAST_WINDOWS = 500_000
UNITS = "km|cm|mm|m|kg|g|mg|lb|lbs|oz|l|ml|h|hr|hrs|min|s|sec|ms|mph|kmh|hours?|minutes?|seconds?|days?|weeks?|months?|years?|miles?|meters?|metres?|feet|inches|percent|dollars?|euros?|degrees?"
NUMBER_WORDS = "(?i:two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|thirteen|fourteen|fifteen|sixteen|seventeen|eighteen|nineteen|twenty|thirty|forty|fifty|sixty|seventy|eighty|ninety|hundred|thousand)"
# placeholder signs, written before the value
NUMBER, NAME, UNIT = "\x01", "\x02", "\x03"


def marked(text: Column, inside: bool = False) -> Column:
    """The text as space-separated lower-case tokens, slots marked and keeping their value; capitals count ``inside`` sentences only or anywhere."""
    name = r"(?<=\p{Ll}[,;]? )" if inside else r"(?<![\p{L}\p{N}\x01-\x03])"
    t = F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), "[\x01\x02\x03]", " ")
    t = F.regexp_replace(t, rf"(?=[efhnstEFHNST])(?<![\p{{L}}\p{{N}}])({NUMBER_WORDS})(?![\p{{L}}\p{{N}}])", f"{NUMBER}$1")
    t = F.regexp_replace(t, rf"(?=\p{{Lu}}){name}(\p{{Lu}}\p{{Ll}}+)", f"{NAME}$1")
    t = F.regexp_replace(t, rf"(\p{{Nd}}+(?:[.,]\p{{Nd}}+)*)(?:\s?({UNITS})(?![\p{{L}}\p{{N}}]))", f" {NUMBER}$1 {UNIT}$2 ")
    t = F.regexp_replace(t, rf"(?<![{NUMBER}\p{{Nd}}.,])(\p{{Nd}}+(?:[.,]\p{{Nd}}+)*)", f" {NUMBER}$1 ")
    t = F.regexp_replace(t, r"[.,](?!\p{Nd})|[^\p{L}\p{N}.,\x01-\x03 ]", " ")
    return F.trim(F.lower(t))


def template(marks: Column) -> Column:
    """Tokens with the values of slots left out."""
    return values(_plain(marks))


def _plain(marks: Column) -> Column:
    return F.regexp_replace(marks, r"([\x01-\x03])\S+", "$1")


def values(marks: Column) -> Column:
    """Tokens with the values of slots kept; in step with ``template``."""
    return F.filter(F.split(marks, " +"), lambda t: t != "")


def _slot(token: Column) -> Column:
    return F.substring(token, 1, 1).isin(NUMBER, NAME, UNIT)


def _heavy(tokens: Column, n: Column) -> Column:
    """Whether too few words of a window of ``n`` are plain."""
    return F.size(F.filter(tokens, _slot)) > n - F.least(F.lit(LITERALS), n)


def _gram(n: int) -> tuple[int, int]:
    """Stride and width of anchors: every window of ``n`` tokens holds one anchor that starts at a multiple of the stride, in step with the document."""
    stride = max(1, n // 2)
    return stride, n - stride + 1


def _anchors(tokens: Column, slots: Column, n: int) -> Column:
    """``(width, anchor, first, part)`` of each anchor: its hash, and the values of the windows that it stands for, which begin at ``first``."""
    stride, gram = _gram(n)
    at = F.when(F.size(tokens) >= n, F.sequence(F.lit(0), F.size(tokens) - gram, F.lit(stride))).otherwise(F.array().cast("array<int>"))
    first = lambda p: F.greatest(p - stride + 1, F.lit(0))
    return F.transform(at, lambda p: F.struct(F.lit(n).alias("width"), F.xxhash64(F.lit(n), F.slice(tokens, p + 1, gram)).alias("anchor"), first(p).alias("first"), F.slice(slots, first(p) + 1, p + n - first(p)).alias("part")))


def _item_anchors(template: Column, n: int) -> Column:
    """The anchors that a window may have in a document, by its place there."""
    stride, gram = _gram(n)
    return F.array(*[F.xxhash64(F.lit(n), F.slice(template, o + 1, gram)) for o in range(stride)])


def _windows(part: Column, first: Column, n: Column) -> Column:
    """``(k, hash)`` of each window of ``n`` tokens in a part: of its template, or of the values where too few words are plain."""
    plain = F.transform(part, _plain)
    hashed = lambda j: F.when(_heavy(F.slice(plain, j + 1, n), n), F.xxhash64(n, F.slice(part, j + 1, n))).otherwise(F.xxhash64(n, F.slice(plain, j + 1, n)))
    return F.transform(F.sequence(F.lit(0), F.size(part) - n), lambda j: F.struct((first + j).alias("k"), hashed(j).alias("hash")))


def items(benchmark: DataFrame) -> DataFrame:
    """Items by id with their window length, tokens and values: capitals as names inside sentences (``tokens``), or anywhere (``named``, ``slots``).

    ``strict`` are the names inside sentences; ``firsts`` are other forms of the first window.
    """
    one = benchmark.where("item_id is not null").groupBy("item_id").agg(F.max(F.col("text").cast("string")).alias("text"))
    led = lambda before, inside: marked(F.concat(F.lit(before), "text"), inside)
    forms = {"": marked(F.col("text"), True), "_any": marked(F.col("text")), "0": led(BEFORE[0], True), "1": led(BEFORE[1], True), "2": led(BEFORE[1], False)}
    marks = one.select("item_id", *[m.alias(f"marks{f}") for f, m in forms.items()])
    out = marks.select("item_id", *[f(F.col(f"marks{i}")).alias(f"{c}{i}") for i in forms for c, f in (("tokens", template), ("slots", values))])
    out = out.where(F.size("tokens") > 0).withColumn("width", F.least(F.size("tokens"), F.lit(WIDTH)))
    firsts = F.array(*[F.struct(F.slice(f"tokens{i}", F.lit(2), F.col("width")).alias("t"), F.slice(f"slots{i}", F.lit(2), F.col("width")).alias("s")) for i in range(3)])
    strict = F.filter("slots", lambda t: F.substring(t, 1, 1) == NAME)
    return out.select("item_id", "tokens", F.col("slots").alias("words"), F.col("tokens_any").alias("named"), F.col("slots_any").alias("slots"), strict.alias("strict"), "width", F.size("tokens").alias("n_item"), firsts.alias("firsts"))


def _item_windows(known: DataFrame) -> DataFrame:
    """``(item_id, width, n_item, total, at, hash, t)`` of every window of the items, in all forms; t is its template."""
    part = lambda c, i: F.slice(c, i + 1, F.col("width"))
    every = lambda t, s: F.transform(F.sequence(F.lit(0), F.col("n_item") - F.col("width")), lambda i: F.struct(i.alias("at"), part(F.col(t), i).alias("t"), part(F.col(s), i).alias("s")))
    first = F.transform("firsts", lambda f: F.struct(F.lit(0).alias("at"), f["t"].alias("t"), f["s"].alias("s")))
    windows = known.select("item_id", "width", "n_item", (F.col("n_item") - F.col("width") + 1).alias("total"), F.explode(F.concat(every("tokens", "words"), every("named", "slots"), first)).alias("w"))
    return windows.select("item_id", "width", "n_item", "total", "w.at", F.when(_heavy(F.col("w.t"), F.col("width")), F.xxhash64("width", "w.s")).otherwise(F.xxhash64("width", "w.t")).alias("hash"), "w.t").distinct()


def held(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``(doc_id, digest, item_id, coverage)`` of every row's id and ``text_digest`` and each item that it holds."""
    known = materialise(items(benchmark))
    lengths = sorted(r.width for r in known.select("width").distinct().collect())
    if not lengths:
        return docs.select("doc_id", text_digest().alias("digest"), F.lit(None).cast(benchmark.schema["item_id"].dataType).alias("item_id"), F.lit(0.0).alias("coverage")).where("false")
    windows = _item_windows(known)
    anchors = F.coalesce(*[F.when(F.col("width") == n, _item_anchors(F.col("t"), n)) for n in lengths])
    anchors, windows = windows.select(F.explode(anchors).alias("anchor")).distinct(), windows.drop("t").distinct()
    if windows.count() <= BROADCAST_WINDOWS:
        anchors, windows = F.broadcast(anchors), F.broadcast(windows)
    marks = docs.select("doc_id", text_digest().alias("digest"), marked(F.col("text")).alias("marks"))
    split = marks.select("doc_id", "digest", template(F.col("marks")).alias("tokens"), values(F.col("marks")).alias("slots"))
    # few parts hold an anchor of the benchmark; the windows of the others meet none
    parts = split.select("doc_id", "digest", F.explode(F.concat(*[_anchors(F.col("tokens"), F.col("slots"), n) for n in lengths])).alias("a")).select("doc_id", "digest", "a.*")
    parts = parts.join(anchors, "anchor", "left_semi")
    seen = parts.select("doc_id", "digest", F.explode(_windows(F.col("part"), F.col("first"), F.col("width"))).alias("w")).select("doc_id", "digest", "w.k", "w.hash")
    met = seen.join(windows, "hash")
    row = ["doc_id", "digest", "item_id", "width", "n_item", "total"]
    lines = met.groupBy(*row, (F.col("k") - F.col("at")).alias("shift")).agg(F.sort_array(F.collect_set("at")).alias("ats"))
    likely = _candidates(materialise(lines), row).withColumn("coverage", F.least(F.col("hits") / F.col("total"), F.lit(1.0)))
    slotted = known.where(F.exists("tokens", _slot)).select("item_id", "slots", "strict")
    if slotted.isEmpty():
        agreed = likely
    else:
        likely = materialise(likely)
        free = likely.join(slotted.select("item_id"), "item_id", "left_anti")
        open_ = likely.join(slotted, "item_id").withColumnsRenamed({"doc_id": "__id", "digest": "__digest"})
        text = docs.select("doc_id", text_digest().alias("digest"), "text")
        both = open_.join(text, F.col("__id").eqNullSafe(F.col("doc_id")) & (F.col("__digest") == F.col("digest")))
        pairs = both.withColumn("own", values(marked(F.col("text")))).withColumn("pair", _pairs(F.col("slots"), F.col("strict"), F.col("own"), F.col("found"), F.col("width")))
        agreed = free.unionByName(pairs.where(_agree(F.col("pair"), F.col("slots"))).select(*free.columns))
    return agreed.groupBy("doc_id", "digest", "item_id").agg(F.max("coverage").alias("coverage"))


def text_digest() -> Column:
    """Tells the texts of rows with one doc_id, or none, apart."""
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def _candidates(lines: DataFrame, row: list[str]) -> DataFrame:
    """``row``, hits and the windows found (``at``, ``shift``): of single alignments, runs, and neighbouring alignments."""
    enough = F.col("hits") >= F.col("total") * SHARE
    spot = lambda a: F.struct(a.alias("at"), F.col("shift"))
    single = lines.withColumn("hits", F.size("ats")).where(enough).select(*row, "hits", F.transform("ats", spot).alias("found"))
    runs = F.array_distinct(F.transform("ats", lambda a, i: a - i))
    long_ = lines.where(F.size("ats") + F.col("width") - 1 >= RUN).select(*row, "shift", "ats", F.explode(runs).alias("run"))
    long_ = long_.withColumn("ats", F.filter("ats", lambda a, i: a - i == F.col("run"))).withColumn("hits", F.size("ats"))
    long_ = long_.where(F.col("hits") + F.col("width") - 1 >= RUN).select(*row, "hits", F.transform("ats", spot).alias("found"))
    # two overlapping stretches of shifts, so that any two within the drift share one
    drift = F.floor(F.col("n_item") / 4)
    j = F.floor(F.col("shift") / drift)
    near = lines.where(F.col("n_item") > WIDTH).select(*row, "shift", F.size("ats").alias("weight"), "ats", F.explode(F.array(j, j - 1)).alias("stretch"))
    near = near.select(*row, "shift", "weight", "stretch", F.explode("ats").alias("at"))
    # an item's window counts once, at its best alignment
    near = near.groupBy(*row, "stretch", "at").agg(F.max(F.struct("weight", (-F.col("shift")).alias("back"))).alias("best"))
    near = near.select(*row, "stretch", F.struct("at", (-F.col("best.back")).alias("shift")).alias("f"))
    near = near.groupBy(*row, "stretch").agg(F.collect_list("f").alias("found"))
    # and so does a document's window
    near = near.withColumn("hits", F.size(F.array_distinct(F.transform("found", lambda f: f["at"] + f["shift"]))))
    return single.unionByName(long_).unionByName(near.where(enough).select(*row, "hits", "found"))


def _pairs(slots: Column, strict: Column, own: Column, found: Column, width: Column) -> Column:
    """The distinct pairs of slot values inside the windows found: an item's, a line end, the document's. Of names those in ``strict``."""
    told = lambda a: _slot(a) & ((F.substring(a, 1, 1) != NAME) | F.array_contains(strict, a))
    places = F.flatten(F.transform(found, lambda f: F.transform(F.sequence(f["at"], f["at"] + width - 1), lambda i: F.struct(F.get(slots, i).alias("a"), F.get(own, (i + f["shift"]).cast("int")).alias("b")))))
    return F.array_distinct(F.transform(F.filter(places, lambda p: told(p["a"]) & p["b"].isNotNull()), lambda p: F.concat(p["a"], F.lit("\n"), p["b"])))


def _agree(pairs: Column, slots: Column) -> Column:
    """Whether each of an item's slot values stands for one of the document's, but for one number that the item has twice: two numbers may be equal by chance."""
    of = lambda p: F.split_part(p, F.lit("\n"), F.lit(1))
    twice = lambda p: (F.substring(p, 1, 1) == NUMBER) & (F.size(F.filter(slots, lambda t: t == of(p))) == 2)
    more = lambda kept: F.size(kept) - F.size(F.array_distinct(F.transform(kept, of)))
    return (more(F.filter(pairs, lambda p: ~twice(p))) == 0) & (more(F.filter(pairs, twice)) <= 1)


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``(doc_id, item_id, coverage)`` of every document and item that it holds; clean documents have no row."""
    return held(docs, benchmark).groupBy("doc_id", "item_id").agg(F.max("coverage").alias("coverage"))


def judge(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, contaminated, n_items, item_id (the smallest held) and the greatest coverage, for each document."""
    found = matches(docs, benchmark).groupBy("doc_id").agg(F.count("*").alias("n_items"), F.min("item_id").alias("item_id"), F.max("coverage").alias("coverage"))
    out = docs.select("doc_id").join(found.withColumnRenamed("doc_id", "__id"), F.col("doc_id").eqNullSafe(F.col("__id")), "left")
    return out.select("doc_id", F.col("n_items").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), "item_id", F.coalesce("coverage", F.lit(0.0)).alias("coverage"))
