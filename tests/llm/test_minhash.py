"""Near-duplicates by MinHash against the shingle sets of all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import types as T

from sentifold.llm import minhash

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("node", T.StringType())])


def plain_set(text):
    words = (text or "").encode().lower().split()
    return frozenset(b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def plain(rows):
    """(doc_id, n_shingles, component_id, kept) of every row."""
    sets = [plain_set(t) for _, t in rows]
    group = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if group[i] != group[j] and a and 100 * len(a & b) >= 85 * len(a | b):
                x, y = group[i], group[j]
                group = [x if g == y else g for g in group]
    names = {}
    for (i, _), g in zip(rows, group, strict=True):
        if i is not None:
            names[g] = min(names.get(g, i), i)
    return [(i, len(s), names.get(g), i == names.get(g)) for (i, _), s, g in zip(rows, sets, group, strict=True)]


def order(rows):
    return sorted(rows, key=lambda r: [(x is None, x or 0) for x in r])


def check(spark, rows, **options):
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], SCHEMA).repartition(3)
    out = minhash.grouped(df, **options)
    assert out.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert order(tuple(r) for r in out.collect()) == order(plain(rows))


def edited(rng, own, edits):
    own = list(own)
    for _ in range(edits):
        own[rng.randrange(len(own))] = "e%d" % rng.randrange(10**6)
    return own


def corpus(seed, n=50):
    """Texts, copies, and copies of copies with edits on both sides of the threshold."""
    rng = random.Random(seed)
    words = ["w%d" % i for i in range(500)]
    rows = []
    for i in rng.sample(range(10_000), n):
        own = rng.choices(words, k=rng.choice([1, 3, 5, 40, 100, 300]))
        rows.append((i, " ".join(own)))
        for k in range(rng.choice([0, 1, 5])):
            own = edited(rng, own, rng.randrange(1 + len(own) // 40))
            rows.append((10_000 + 10 * i + k, rng.choice([" ", "\n", " \t"]).join(own).title()))
    rows += [(90_000, None), (90_001, " \t\n"), (None, rows[0][1]), (None, "only null"), (None, None), rows[3], rows[3]]
    rows += [(90_002, "Long Text " * 40_000), (90_003, "long text " * 39_000), (90_004, "a b c\x1fd e f g")]
    rng.shuffle(rows)
    return rows


def one_group(seed, n, edits, size=120):
    rng = random.Random(seed)
    base = ["b%d" % i for i in range(size)]
    return [(i, " ".join(edited(rng, base, edits))) for i in rng.sample(range(10 * n), n)]


def test_groups_are_those_of_all_pairs(spark):
    check(spark, corpus(1))


def test_large_group_near_the_threshold_in_many_blocks(spark):
    check(spark, one_group(2, 300, 2) + one_group(3, 60, 1, 40) + corpus(4, 10), block_rows=16, block_bytes=20_000)


def test_empty_table(spark):
    check(spark, [])


def test_chance_of_a_lost_link():
    assert (1 - 0.85**minhash.ROWS) ** minhash.BANDS < 1e-6
    rng = np.random.default_rng(1)
    for _ in range(40):  # pairs exactly at the threshold: 85 common of 100
        x = rng.integers(1 << 63, size=100, dtype=np.uint64)
        a, b = np.unique(x[:92]), np.unique(np.concatenate([x[:85], x[92:]]))
        assert minhash.similar(a, b)
        least = minhash.minima([a, b])
        assert (minhash.band_keys(least)[0] == minhash.band_keys(least)[1]).any()
        assert (least[0].astype(np.uint8) == least[1].astype(np.uint8)).sum() >= minhash.LEAST_EQUAL


@pytest.mark.parametrize("common,expected", [(85, True), (84, False)])
def test_threshold_is_exact(common, expected):
    a, b = np.arange(92, dtype=np.uint64), np.arange(92, dtype=np.uint64) + np.uint64(92 - common)
    union = 92 * 2 - common
    assert minhash.similar(a, b) == (100 * common >= 85 * union)
    x = np.arange(common, dtype=np.uint64)
    assert minhash.similar(x, np.arange(100, dtype=np.uint64)) == expected
