"""Secret scans with DataFrame expressions only.

Three base kinds follow fixed patterns. Beside them, candidate strings (long
runs of key signs) are judged by the Shannon entropy of a sliding window, kept
up to date by incremental counts, with a threshold for each window's character
class; an allow-list suppresses strings that are random by nature but no secrets.
Words and paths of words have a threshold of their own, part by part. Of a
candidate that holds base spans, the parts outside them are spans as well.

Null texts count as empty and have no spans. Spans are in code points, end
exclusive. Repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# runs are maximal, so the least length can be part of the pattern
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "entropy")

WINDOW = 20
#: The signs of candidates, in the order of their codes; any other sign counts as one more.
SIGNS = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/_=-"
#: Counts are below 32; so many of them lie in a number of 64 bits.
PACKED = 12
#: The least entropy of a window in bits, by class: hexadecimal digits, capitals and digits, any key signs.
LEAST = {"hex": 3.0, "upper": 3.5, "key": 3.75}
ALLOWED = [
    r"(?i)example|sample|placeholder|changeme|xxxx|abcdefgh|01234567",
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^[0-9+/_=-]+$",
]
#: Parts between separators that are written like words; with digits behind them only in paths.
SEPARATORS = "[-_/+=]"
WORD = r"(?:[a-z]+(?:[A-Z]{1,5}[a-z]{2,}){0,6}|(?:[A-Z]{1,5}[a-z]{2,}){1,6}|[A-Z][a-z]|[A-Z]+)?"
WORD_BITS = 3.9
#: A part of a candidate beside a base span that is so short and written like a word is text.
SHORT = 4

SPANS = "array<struct<start:bigint,rank:int,end:bigint>>"


def _positions(text: Column, pattern: str, matches: Column, rank: int, keep) -> Column:
    """Spans of the matches, from the lengths of the pieces between them."""
    between = F.split(text, pattern, -1)
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(SPANS).alias("found"))

    def step(acc: Column, pair: Column) -> Column:
        first = acc["at"] + F.length(pair["gap"])
        end = first + F.length(pair["hit"])
        span = F.struct(first.cast("bigint").alias("start"), F.lit(rank).alias("rank"), end.cast("bigint").alias("end"))
        return F.struct(end.cast("bigint").alias("at"), F.when(keep(pair["hit"]), F.concat(acc["found"], F.array(span))).otherwise(acc["found"]).alias("found"))

    pairs = F.zip_with(F.slice(between, 1, F.size(matches)), matches, lambda gap, hit: F.struct(gap.alias("gap"), hit.alias("hit")))
    return F.when(F.size(matches) == 0, F.array().cast(SPANS)).otherwise(F.aggregate(pairs, start, step, lambda acc: acc["found"]))


def window_bits(s: Column, window: int = WINDOW) -> Column:
    """The greatest entropy in bits of ``window`` signs of a string, by class: a struct of hex, upper and key.

    Sliding by one sign changes two counts; the sum of ``n * log2(n)`` follows.
    Counts are kept in a few packed numbers. Windows of digits alone are keys only.
    """
    longs = -(-(len(SIGNS) + 1) // PACKED)
    code = lambda i: F.pmod(F.instr(F.lit(SIGNS), s.substr(i, F.lit(1))) - 1, F.lit(len(SIGNS) + 1))
    steps = F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.struct(i.alias("i"), code(i).alias("came"), F.when(i > window, code(F.greatest(i - window, F.lit(1)))).otherwise(F.lit(-1)).alias("went")))
    logs = F.lit([0.0] + [n * math.log2(n) for n in range(1, window + 2)])
    nlogn = lambda n: F.element_at(logs, n.cast("int") + 1)
    unit = lambda c: F.call_function("shiftleft", F.lit(1).cast("bigint"), (c % PACKED) * 5)
    start = F.struct(*[F.lit(0).cast("bigint").alias(f"n{k}") for k in range(longs)], *[F.lit(0).alias(f"run_{c}") for c in ("digit", "hex", "upper")], F.lit(0.0).alias("sum"), *[F.lit(0.0).alias(c) for c in LEAST])

    def count(acc: Column, c: Column) -> Column:
        held = F.element_at(F.array(*[acc[f"n{k}"] for k in range(longs)]), F.floor(c / PACKED).cast("int") + 1)
        return F.call_function("shiftright", held, (c % PACKED) * 5).bitwiseAND(F.lit(31).cast("bigint"))

    def step(acc: Column, p: Column) -> Column:
        came, went, full = p["came"], p["went"], p["i"] >= window
        before = count(acc, came)
        more = acc["sum"] - nlogn(before) + nlogn(before + 1)
        left = count(acc, F.greatest(went, F.lit(0))) + F.when(went == came, 1).otherwise(0)
        total = F.when(went >= 0, more - nlogn(left) + nlogn(F.greatest(left - 1, F.lit(0)))).otherwise(more)
        moved = lambda k: F.when(F.floor(came / PACKED) == k, unit(came)).otherwise(F.lit(0).cast("bigint")) - F.when((went >= 0) & (F.floor(went / PACKED) == k), unit(F.greatest(went, F.lit(0)))).otherwise(F.lit(0).cast("bigint"))
        capital = lambda last: (came >= 36) & (came < last)
        kinds = {"digit": came < 10, "hex": (came < 16) | capital(42), "upper": (came < 10) | capital(62)}
        run = {c: F.when(ok, acc[f"run_{c}"] + 1).otherwise(F.lit(0)) for c, ok in kinds.items()}
        bits = F.lit(math.log2(window)) - total / window
        only = {"hex": (run["hex"] >= window) & (run["digit"] < window), "upper": (run["upper"] >= window) & (run["digit"] < window), "key": F.lit(True)}
        best = [F.when(full & ok, F.greatest(acc[c], bits)).otherwise(acc[c]).alias(c) for c, ok in only.items()]
        return F.struct(*[(acc[f"n{k}"] + moved(k)).alias(f"n{k}") for k in range(longs)], *[r.alias(f"run_{c}") for c, r in run.items()], total.alias("sum"), *best)

    return F.aggregate(steps, start, step, lambda acc: F.struct(*[acc[c].alias(c) for c in LEAST]))


def window_entropy(s: Column, window: int = WINDOW) -> Column:
    """The greatest entropy in bits of any ``window`` signs of a string; 0 if it is shorter."""
    return F.when(F.length(s) >= window, window_bits(s, window)["key"]).otherwise(F.lit(0.0))


def _random(hit: Column) -> Column:
    """Whether a candidate is a secret by entropy: a window over its class's threshold, and no allow-list hit."""
    allowed = F.lit(False)
    for pattern in ALLOWED:
        allowed = allowed | hit.rlike(pattern)
    path = _like_words(hit, digits=True) & (F.regexp_count(hit, F.lit("/")) >= 2)
    by_part = F.exists(F.split(hit, SEPARATORS), lambda part: window_entropy(part) >= WORD_BITS)
    over = F.exists(F.array(window_bits(hit)), lambda w: (w["hex"] >= LEAST["hex"]) | (w["upper"] >= LEAST["upper"]) | (w["key"] >= LEAST["key"]))
    return F.when(allowed, F.lit(False)).when(path | _like_words(hit), by_part).otherwise(over)


def _like_words(hit: Column, digits: bool = False) -> Column:
    """Whether every part between separators is written like a word."""
    return F.forall(F.split(hit, SEPARATORS), lambda part: part.rlike(f"^{WORD}{'[0-9]{0,6}' * digits}$"))


def _outside(text: Column, base: Column, more: Column) -> Column:
    """The candidates ``more`` without what base spans cover."""

    def apart(m: Column) -> Column:
        met = F.filter(base, lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"]))
        start = F.struct(m["start"].alias("at"), F.array().cast(SPANS).alias("out"))
        cut = lambda at, to: F.array(F.struct(at.alias("start"), F.lit(3).alias("rank"), to.alias("end")))

        def step(acc: Column, b: Column) -> Column:
            out = F.when((b["start"] > acc["at"]) & _rest(_part(text, acc["at"], b["start"]), b["rank"] == 0), F.concat(acc["out"], cut(acc["at"], b["start"]))).otherwise(acc["out"])
            return F.struct(F.greatest(acc["at"], b["end"]).alias("at"), out.alias("out"))

        def last(acc: Column) -> Column:
            return F.when((m["end"] > acc["at"]) & _rest(_part(text, acc["at"], m["end"]), F.lit(False)), F.concat(acc["out"], cut(acc["at"], m["end"]))).otherwise(acc["out"])

        return F.when(F.size(met) == 0, F.array(m)).otherwise(F.aggregate(met, start, step, last))

    return F.flatten(F.transform(more, apart))


def _part(text: Column, start: Column, end: Column) -> Column:
    return text.substr((start + 1).cast("int"), (end - start).cast("int"))


def _rest(part: Column, named: Column) -> Column:
    """Whether what stands beside a base span belongs to the secret: separators, labels and the names of assignments do not."""
    label = _like_words(part) & ((F.length(part) < SHORT) | part.rlike(f"{SEPARATORS}$") | named)
    return ~(part.rlike(f"^{SEPARATORS}+$") | label | (_like_words(part, digits=True) & part.endswith("=")))


def spans(docs: DataFrame) -> DataFrame:
    """``docs`` with ``__base`` and ``__spans``: base spans and all spans, sorted."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    found = docs.withColumns({"__text": text} | {f"__{k}": F.regexp_extract_all(text, F.lit(p), 0) for k, p in zip(KINDS, (ASSIGN, ACCESS, HEX, CANDIDATE))})
    always = lambda hit: F.lit(True)
    long_enough = lambda hit: F.length(F.regexp_extract(hit, ASSIGN, 2)) >= 6
    base = F.array_sort(
        F.concat(
            _positions(F.col("__text"), ASSIGN, F.col("__assign"), 0, long_enough),
            _positions(F.col("__text"), ACCESS, F.col("__access"), 1, always),
            _positions(F.col("__text"), HEX, F.col("__hex"), 2, always),
        )
    )
    found = found.withColumns({"__base": base, "__more": _positions(F.col("__text"), CANDIDATE, F.col("__entropy"), 3, _random)})
    apart = _outside(F.col("__text"), F.col("__base"), F.col("__more"))
    return found.withColumn("__spans", F.array_sort(F.concat("__base", apart))).drop("__text", "__more", *[f"__{k}" for k in KINDS])


def _written(found: Column) -> Column:
    kind = F.lit(list(KINDS))
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.element_at(kind, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans and n_entropy of every text."""
    of = lambda rank: F.size(F.filter("__spans", lambda s: s["rank"] == rank)).cast("long")
    found = spans(docs.select("doc_id", "text"))
    return found.select(
        "doc_id",
        *[of(i).alias(f"n_{KINDS[i]}") for i in range(3)],
        F.sha2(_written(F.col("__base")), 256).alias("base_sha256"),
        _written(F.col("__spans")).alias("spans"),
        of(3).alias("n_entropy"),
    )


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """The documents with every span replaced by a mark; n_chars follows where it exists."""
    found = spans(docs)
    text = F.col("text")
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        gap = text.substr((acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh, F.concat(acc["out"], gap, F.lit(mark))).otherwise(acc["out"]).alias("out"))

    clean = F.aggregate("__spans", start, step, lambda acc: F.concat(acc["out"], text.substr((acc["at"] + 1).cast("int"), F.length(text))))
    out = found.withColumn("text", F.when(F.size("__spans") > 0, clean).otherwise(text))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size("__spans") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
