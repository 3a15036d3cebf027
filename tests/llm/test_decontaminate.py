from vectide.llm.decontaminate import judge, matches

ITEMS = {
    1: "A train leaves the old station with 12 wagons and travels 300 km before it stops near Berlin for coal and water.",
    2: "What is the capital of the northern province?",
    3: "Tiny one",
    4: None,
    5: "",
}


def run(spark, texts):
    docs = spark.createDataFrame([(d, t, 7) for d, t in texts.items()], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame(list(ITEMS.items()), "item_id long, text string")
    return {r.doc_id: r for r in judge(docs, bench).collect()}


def test_templates_slots_and_clean_documents(spark):
    filler = "some other prose that goes on and on without end or aim of any kind "
    texts = {
        1: filler + ITEMS[1] + filler,
        2: filler + ITEMS[1].replace("12", "45").replace("300", "77.5").replace("Berlin", "Paris") + filler,
        3: filler * 40,
        4: None,
        5: "",
        6: "A train leaves the old station with nothing at all, and then quite another story begins here.",
        7: ITEMS[2].upper(),
        8: "tiny one",
        9: "12 13 14 15 16 17 18 19 20 21 22",
    }
    got = run(spark, texts)
    assert {d for d, r in got.items() if r.contaminated} == {1, 2, 7, 8}
    assert (got[1].item_id, got[7].item_id, got[8].item_id) == (1, 2, 3)
    assert got[1].coverage == 1.0 and got[3].coverage == 0.0 and got[3].item_id is None


def test_contradicting_slots_are_no_match(spark):
    item = "first take 5 apples then add 5 pears and then remove 5 plums from the big basket"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = spark.createDataFrame([(1, item.replace("5", "8")), (2, item.replace("5 p", "9 p"))], "doc_id long, text string")
    assert [r.doc_id for r in matches(docs, bench).collect()] == [1]


def test_every_passage_of_the_benchmark_is_found(spark, sf):
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    passages = [r.text for r in bench.collect()]
    held = {r.doc_id for r in docs.collect() if any(p in r.text for p in passages)}
    assert {r.doc_id for r in judge(docs, bench).where("contaminated").collect()} == held


def test_empty_tables(spark):
    none, bench = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert judge(none, bench).count() == 0
    assert judge(none, bench.limit(0)).count() == 0
    assert not judge(spark.createDataFrame([(1, "a b c")], "doc_id long, text string"), bench.limit(0)).first().contaminated


def test_edited_partial_and_slot_heavy_copies(spark):
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "nu", "re", "so", "ta", "vu", "wo", "xa") for b in "bcdfghjklmnpqrst"]
    mixed = words[:10] + ["with 5 apples and 7 pears"] + words[10:24]
    repeated = "add 5 apples to the big blue basket then add 7 apples to the big blue basket then " + " ".join(words[100:124])
    bench = {
        1: " ".join(words[:40]),
        2: " ".join(words[40:100]),
        3: " ".join(words),
        4: "What is 17 + 25?",
        5: "Who is Ada Lovelace?",
        6: "Compute 12 * 13 - 4 / 2 + 9 * 3",
        7: " ".join(mixed),
        8: repeated,
        9: "ha " * 40,
    }
    filler = "some other prose that goes on and on "
    texts = {
        1: " ".join([*words[:20], "zig", *words[20:40]]),
        2: " ".join([*words[40:70], *words[71:100]]),
        3: filler + " ".join(words[105:155]) + " " + filler,
        4: filler + bench[4],
        5: "they asked " + bench[5],
        6: filler + bench[6] + " and so on",
        7: " ".join(mixed).replace("7", "5"),
        8: " ".join(mixed).replace(words[15], "Zed"),
        9: filler + repeated,
        10: "What is 18 + 26?",
        11: filler + "ha " * 8,
        12: " ".join(words[105:125]),
    }
    docs = spark.createDataFrame([(d, t) for d, t in texts.items()] + [(None, texts[1]), (None, filler)], "doc_id long, text string")
    got = {}
    for r in matches(docs, spark.createDataFrame(list(bench.items()), "item_id long, text string")).collect():
        got.setdefault(r.doc_id, set()).add(r.item_id)
    want = {1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 6, 7: 7, 8: 7, 9: 8, None: 1}
    assert {d: i for d, i in want.items() if i not in got.get(d, ())} == {}
    assert {10, 11, 12}.isdisjoint(got)


def test_questions_with_other_values_are_caught(spark):
    import random

    rng = random.Random(12)
    names = ["Ada", "Boris", "Clara", "Dmitri", "Elena", "Farid"]
    words = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(20) for j in range(20)]
    benchmark, docs, want = [], [], set()
    for i in range(40):
        plain = lambda n: " ".join(rng.choice(words) for _ in range(n))
        form = f"{plain(4)} {{n}} {plain(5)} {{a}} {plain(4)} {{b}} km {plain(6)}"
        item = dict(n=rng.choice(names), a=rng.randrange(1, 99), b=rng.randrange(1, 99))
        benchmark.append((i, form.format(**item)))
        other = dict(n=rng.choice(names), a=rng.randrange(100, 999), b=rng.randrange(100, 999))
        if i % 4 == 0:
            other["b"] = other["a"]  # two slots that happen to take one value
        docs.append((i, f"{plain(30)} {form.format(**other)} {plain(30)}"))
        want.add((i, i))
        docs.append((1000 + i, plain(90)))
    frame = lambda rows, name: spark.createDataFrame(rows, f"{name} long, text string")
    from vectide.llm.decontaminate import matches

    got = {(r.doc_id, r.item_id) for r in matches(frame(docs, "doc_id"), frame(benchmark, "item_id")).collect()}
    assert got <= want and len(got) >= 0.9 * len(want)


def test_long_texts_and_repeated_ids(spark, sf):
    from vectide.llm.decontaminate import held

    item = spark.read.parquet(f"{sf}/benchmark.parquet").first()
    far = "plain words go on and on " * 40_000
    rows = [(1, far + item.text + " " + far, 7), (2, far, 7), (3, item.text, 8), (3, "other text", 9), (3, item.text, 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id int")
    got = held(docs.drop("item_id"), spark.read.parquet(f"{sf}/benchmark.parquet")).where(f"item_id = {item.item_id}").collect()
    assert sorted({r.doc_id for r in got}) == [1, 3] and len([r for r in got if r.doc_id == 3]) == 1


NAMES = ["Anna", "Peter", "Lucy", "Mark", "Olga", "Samir", "Tess", "Bruno"]
NUMBERS = ["4", "12", "nine", "seven", "35", "1,200", "fifty", "eleven"]
PROBLEMS = [
    "{a} walked to the market on a cold morning with a basket. {a} bought {x} apples from an old farmer near the gate. {b} asked for some of them later. {a} gave back {y} of the apples before the sun went down. How many apples did {a} keep in the end?",
    "{a} reads {x} pages every evening after dinner. {b} reads {y} pages at the same desk. The book of both readers has the same length. Who of {a} and {b} finishes it first?",
    "On the way to school {a} found {x} coins under a tree. {b} found {y} coins more than that. Together with {a} the two friends bought a kite. What was left of the coins?",
    "{a} painted the long fence in the garden. {b} painted the short one beside the house. {a} needed {x} buckets of white paint. {b} needed {y} buckets of the green one.",
    "Nobody in the small village had seen {a} for weeks. Then {b} met {a} with {x} sheep and {y} goats on the hill. They talked about the weather and the harvest until the evening came.",
]


def problem(rng, form):
    a, b = rng.sample(NAMES, 2)
    x, y = rng.choice(NUMBERS), rng.choice(NUMBERS)
    return form.format(a=a, b=b, x=x, y=y)


def test_word_problems_with_names_at_sentence_starts_and_number_words(spark):
    """Several sentences each, names at starts and inside, values that coincide, numbers as figures or words."""
    import random

    rng = random.Random(21)
    words = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(20) for j in range(20)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n)).capitalize() + ". "
    benchmark = [(i, problem(rng, form)) for i, form in enumerate(PROBLEMS)]
    docs, want = [], set()
    for i, form in enumerate(PROBLEMS):
        for j in range(20):
            docs.append((100 * i + j, prose(40) + problem(rng, form) + " " + prose(40)))
            want.add((100 * i + j, i))
        docs.append((100 * i + 50, prose(20) + benchmark[i][1].lower() + " " + prose(20)))
        want.add((100 * i + 50, i))
    docs += [(5000 + j, "".join(prose(12) for _ in range(20))) for j in range(20)]
    # the same kind of question in other words is none of them
    docs += [(6000, "Anna went to the market. Peter saw 12 apples there. Lucy sold 4 of them. How many were left when Mark came back?"), (6001, "Peter reads a book every evening. Lucy paints the fence. They talked about the harvest.")]
    got = {(r.doc_id, r.item_id) for r in matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(benchmark, "item_id long, text string")).collect()}
    assert got <= want and len(got) >= 0.9 * len(want), (len(got), len(want))


def test_slots_that_contradict_each_other_are_no_match(spark):
    item = "{} has red apples in the big basket and {} has green pears in the small basket while {} has nothing at all to eat"
    benchmark = [(1, "We saw that " + item.format("Anna", "Peter", "Anna"))]
    docs = [(1, "We saw that " + item.format("Lucy", "Mark", "Lucy")), (2, "We saw that " + item.format("Lucy", "Mark", "Olga"))]
    got = [r.doc_id for r in matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(benchmark, "item_id long, text string")).collect()]
    assert got == [1]


def test_two_numbers_of_an_item_may_be_equal_by_chance(spark):
    item = "the shop sold {} red kites on monday and {} blue kites on friday and {} green kites on sunday before it closed"
    docs = [(1, item.format(8, 9, 3)), (2, item.format(8, 8, 8)), (3, item.format(8, 9, 7))]
    bench = spark.createDataFrame([(1, item.format(5, 5, 2)), (2, item.format(5, 5, 5).replace("kites", "balls"))], "item_id long, text string")
    got = sorted(tuple(r) for r in matches(spark.createDataFrame(docs + [(4, docs[0][1].replace("kites", "balls"))], "doc_id long, text string"), bench).select("doc_id", "item_id").collect())
    assert got == [(1, 1), (2, 1), (3, 1)]


def test_windows_are_hashed_only_beside_anchors_and_none_is_lost(spark):
    from pyspark.sql import functions as F
    from vectide.llm.decontaminate import _anchors, _gram, _item_anchors, _windows

    sizes = list(range(21))
    words = [[f"\x01{j}" if j % 3 == 2 else f"w{j}" for j in range(size)] for size in sizes]
    docs = spark.createDataFrame(list(zip(sizes, words)), "size int, slots array<string>").withColumn("tokens", F.transform("slots", lambda t: F.regexp_replace(t, "\x01.*", "\x01")))
    for n in range(1, 9):
        parts = docs.select("size", "tokens", F.explode(_anchors(F.col("tokens"), F.col("slots"), n)).alias("a")).select("size", "tokens", "a.*")
        seen = parts.select("size", "tokens", "anchor", F.explode(_windows(F.col("part"), F.col("first"), F.col("width"))).alias("w"))
        own = seen.select("size", "w.k", F.array_contains(_item_anchors(F.slice("tokens", F.col("w.k") + 1, n), n), F.col("anchor")).alias("told")).collect()
        assert sorted((r.size, r.k) for r in own) == [(size, k) for size in sizes for k in range(size - n + 1)]
        assert all(r.told for r in own)
        stride, gram = _gram(n)
        assert parts.count() == sum((size - gram) // stride + 1 for size in sizes if size >= n)
    # a quarter of the places is hashed where no item is near
    assert _gram(8) == (4, 5)


def test_items_of_any_width_are_found_at_any_place(spark):
    bench = {n: " ".join(f"item{chr(97 + n)}{chr(97 + j)}" for j in range(n)) for n in range(1, 11)}
    docs = [(100 * n + k, " ".join(["prose"] * k + [bench[n]] + ["prose"] * (k % 3))) for n in bench for k in range(10)]
    got = {(r.doc_id, r.item_id) for r in matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(list(bench.items()), "item_id long, text string")).collect()}
    assert got == {(d, d // 100) for d, _ in docs}
