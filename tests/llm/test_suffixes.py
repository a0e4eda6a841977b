"""Repeated passages against a table of all windows of words."""

import random
from collections import defaultdict

from pyspark.sql import types as T

from sentifold.llm import suffixes

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("run", T.StringType())])


def spans_of(marked):
    out = []
    for w in sorted(marked):
        if out and out[-1][1] == w:
            out[-1][1] = w + 1
        else:
            out.append([w, w + 1])
    return [tuple(x) for x in out]


def plain(rows, size=50):
    """Row number to (repeated, copies)."""
    seen = defaultdict(list)
    for n, (i, t) in enumerate(rows):
        words = (t or "").encode().lower().split()
        for p in range(len(words) - size + 1):
            seen[tuple(words[p : p + size])].append((i is None, i or 0, n, p))
    repeated, copies = defaultdict(set), defaultdict(set)
    for places in seen.values():
        if len(places) > 1:
            for place in places:
                repeated[place[2]].update(range(place[3], place[3] + size))
                if place != min(places):
                    copies[place[2]].update(range(place[3], place[3] + size))
    return {n: (spans_of(m), spans_of(copies[n])) for n, m in repeated.items()}


def corpus(rng, n):
    vocabulary = ["w%d" % i for i in range(3000)]
    new = lambda k: rng.choices(vocabulary, k=k)
    shared = [new(k) for k in (49, 50, 51, 55, 64, 65, 66, 80, 200)]
    rows = []
    for i in range(n):
        words = new(rng.randrange(0, 120))
        for _ in range(rng.choice([0, 0, 1, 2])):
            p = rng.choice(shared)
            words += [w.upper() if rng.random() < 0.1 else w for w in p] + new(rng.randrange(0, 60))
        rows.append((i, rng.choice([" ", "\n", " \t"]).join(words)))
    return rows


def found(spark, rows, **options):
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], SCHEMA)
    out = suffixes.repeated(df, bits=20, **options).collect()
    as_spans = lambda x: [(s["low"], s["high"]) for s in x]
    return sorted((r["doc_id"], as_spans(r["repeated"]), as_spans(r["copies"])) for r in out)


def check(spark, rows, **options):
    want = sorted((rows[n][0], *x) for n, x in plain(rows).items())
    assert found(spark, rows, **options) == want


def test_passages(spark):
    check(spark, corpus(random.Random(5), 60))


def test_a_common_passage_over_many_ranges(spark):
    rng = random.Random(6)
    common = [f"c{i}" for i in range(70)]
    rows = [(i, " ".join([f"a{rng.random()}", *common, f"b{rng.random()}"])) for i in range(60)]
    check(spark, rows, rows_per_range=25)


def test_repeated_rows_and_long_texts(spark):
    rng = random.Random(7)
    text = " ".join(f"x{rng.random()}" for _ in range(20_000))
    rows = [(3, text), (3, text), (9, None), (9, ""), (10, "short"), (11, text[: len(text) // 2])]
    got = found(spark, rows)
    n, half = 20_000, len(rows[5][1].split()) - 1
    assert (3, [(0, n)], []) in got and (3, [(0, n)], [(0, n)]) in got
    assert got[-1][0] == 11 and got[-1][2][0][1] in (half, half + 1)


def test_cut_keeps_first_and_everything_else(spark):
    rows = corpus(random.Random(8), 40) + [(None, None), (500, "")]
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], SCHEMA)
    got = {r["doc_id"]: r["text"] for r in suffixes.without_copies(df, bits=20).collect()}
    cut = plain(rows)
    for n, (i, t) in enumerate(rows):
        words = (t or "").split()
        gone = {w for a, b in cut.get(n, ((), ()))[1] for w in range(a, b)}
        left = [w for k, w in enumerate(words) if k not in gone]
        if gone and not left:
            assert i not in got
        else:
            assert (got[i] or "").split() == left
    assert suffixes.without_copies(df.limit(0), bits=20).count() == 0


def test_empty_table(spark):
    assert suffixes.repeated(spark.createDataFrame([], SCHEMA), bits=20).collect() == []


def test_templated_texts(spark):
    rng = random.Random(9)
    new = lambda k: rng.choices(["t%d" % i for i in range(3000)], k=k)
    headers, body, footers = [new(20) for _ in range(8)], new(30), [new(20) for _ in range(8)]
    rows = [(i, " ".join(rng.choice(headers) + body + rng.choice(footers))) for i in range(300)]
    check(spark, rows)
    check(spark, rows, rows_per_range=50)


def test_nothing_unique_is_cut(spark):
    rng = random.Random(10)
    new = lambda k: rng.choices(["t%d" % i for i in range(3000)], k=k)
    rows = []
    for _ in range(30):
        p, q, thrice = new(53), new(20), new(60)
        rows += [(len(rows), " ".join(p)), (len(rows) + 1, " ".join(p + q)), (len(rows) + 2, " ".join(p + q)), (len(rows) + 3, " ".join(thrice * 3))]
    check(spark, rows)
    check(spark, rows, rows_per_range=50)
