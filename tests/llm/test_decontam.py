"""Benchmark items in documents, against edit distances of all pairs."""

import random

from pyspark.sql import types as T

from sentifold.llm import decontam

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("item_id", T.StringType())])
ITEMS = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("row", T.LongType())])


def distance(item, words):
    """Edits to the nearest part, by the plain table."""
    above = [0] * (len(words) + 1)
    for i, x in enumerate(item):
        row = [i + 1]
        for j, y in enumerate(words):
            row.append(min(above[j] + (x != y), above[j + 1] + 1, row[j] + 1))
        above = row
    return min(above)


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        i, kind = rng.randrange(len(words)), rng.random()
        if kind < 0.6:
            words[i] = f"e{rng.random()}"[:9]
        elif kind < 0.8:
            words.insert(i, f"e{rng.random()}"[:9])
        else:
            del words[i]
    return words


def found(spark, docs, items, **options):
    d = spark.createDataFrame([(i, t, "clash") for i, t in docs], DOCS)
    b = spark.createDataFrame([(i, t, 0) for i, t in items], ITEMS)
    return decontam.contaminated(d, b, **options).collect()


def test_nearest_part():
    rng = random.Random(1)
    for _ in range(300):
        item = rng.choices("abc", k=rng.randrange(1, 9))
        words = rng.choices("abc", k=rng.randrange(0, 20))
        assert decontam.nearest(item, words)[0] == distance(item, words)


def test_recall_and_exactness(spark):
    rng = random.Random(2)
    vocabulary = [f"v{i}" for i in range(2000)]
    items = [(i, rng.choices(vocabulary, k=rng.randrange(12, 90))) for i in range(60)]
    docs = []
    for i in range(400):
        words = rng.choices(vocabulary, k=rng.randrange(0, 150))
        if i % 2:
            _, w = rng.choice(items)
            p = rng.randrange(len(words) + 1)
            words[p:p] = edited(rng, w, rng.randrange(int(0.3 * len(w))) if i % 4 == 1 else 0)
        docs.append((i, words))
    text = lambda w: rng.choice([" ", "\n", ", "]).join(w).title()
    out = found(spark, [(i, text(w)) for i, w in docs], [(i, text(w)) for i, w in items])
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in out}
    plain = lambda w: decontam.words_of(" ".join(w).encode())
    all_items = {i: plain(w) for i, w in items}
    want = {}
    for i, w in docs:
        own = plain(w)
        for k, item in all_items.items():
            d = distance(item, own)
            if d <= int(0.2 * len(item) + 1e-9):
                want[i, k] = d
    assert set(got) <= set(want) and all(want[p] == d for p, d in got.items())
    exact = {p for p, d in want.items() if d == 0}
    assert exact <= set(got) and len(exact) >= 100
    assert len(got) >= 0.95 * len(want) and len(want) > len(exact) + 30


def test_short_empty_null_and_repeated(spark):
    docs = [(1, None), (2, ""), (3, "One two three four."), (3, "One two three four."), (None, "xx one TWO yy"), (5, "a" * 200_000 + " one " + "b " * 50_000 + "long item " * 300)]
    items = [(10, None), (11, "!?"), (12, "two"), (12, "two"), (None, "one two"), (14, "long item " * 300)]
    out = sorted(((r["doc_id"] or 0, r["item_id"] or 0, r["distance"]) for r in found(spark, docs, items)))
    assert out == [(0, 0, 0), (0, 12, 0), (0, 12, 0), (3, 0, 0), (3, 0, 0), (3, 12, 0), (3, 12, 0), (3, 12, 0), (3, 12, 0), (5, 14, 0)]


def test_empty_tables(spark):
    assert found(spark, [], [(1, "a b c")]) == []
    assert found(spark, [(1, "a b c")], []) == []


def test_clean_keeps_columns(spark):
    d = spark.createDataFrame([(1, "has the very item here", "x"), (2, "nothing", "y"), (None, None, None)], DOCS)
    b = spark.createDataFrame([(1, "the very item", 0)], ITEMS)
    assert sorted(map(tuple, decontam.clean(d, b).collect()), key=str) == [(2, "nothing", "y"), (None, None, None)]


def test_recall_at_the_threshold_for_each_size(spark):
    rng = random.Random(4)
    vocabulary = [f"v{i}" for i in range(20_000)]
    new = lambda k: rng.choices(vocabulary, k=k)
    sizes, each = (5, 6, 9, 10, 11, 15, 20, 23, 24, 30, 39, 40, 79, 159, 319), 100
    docs, items = [], []
    for n in sizes:
        for _ in range(each):
            item = new(n)
            docs.append((len(docs), " ".join(new(rng.randrange(60)) + edited(rng, item, n // 5) + new(rng.randrange(60))).replace(".", "")))
            items.append((len(items), " ".join(item)))
    hits = {r["item_id"] for r in found(spark, docs, items) if r["doc_id"] == r["item_id"]}
    recall = {n: sum(k * each + i in hits for i in range(each)) / each for k, n in enumerate(sizes)}
    assert min(recall.values()) >= 0.95, recall
