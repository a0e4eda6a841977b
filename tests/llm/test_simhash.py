"""Fingerprints and groups against all pairs."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sentifold.llm import simhash
from sentifold.llm.common import written
from sentifold.llm.components import components

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("root", T.StringType())])


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows):
    """Smallest reachable id by position of the row."""
    fps = [plain_fingerprint(t) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3 and group[i] != group[j]:
                a, b = group[i], group[j]
                group = [a if g == b else g for g in group]
    least = {}
    for (i, _), g in zip(rows, group, strict=True):
        if i is not None:
            least[g] = min(least.get(g, i), i)
    return [(i, f"{f:016x}", least.get(g)) for (i, _), f, g in zip(rows, fps, group, strict=True)]


def corpus(seed, n=150):
    rng = random.Random(seed)
    words = ["w%d" % i for i in range(500)]
    rows = []
    for i in rng.sample(range(10_000), n):
        if rows and rng.random() < 0.6:
            text = (rng.choice(rows)[1] or "").split(" ")
            if len(text) > 30 and rng.random() < 0.7:
                text[rng.randrange(len(text))] = rng.choice(words)
            rows.append((i, " ".join(text)))
        else:
            rows.append((i, " ".join(rng.choices(words, k=rng.choice([1, 2, 3, 40, 300])))))
    return rows + [(20_000, None), (20_001, " \t\n"), (None, rows[0][1]), (None, "only null"), rows[3], rows[3], (30_000, "Long Text " * 40_000)]


def result(spark, rows):
    df = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)
    kept = written(simhash.with_fingerprint(df), "t")
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return sorted(map(tuple, simhash.grouped(kept).select("doc_id", hexed, "component_id").collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_groups(spark, seed):
    rows = corpus(seed)
    assert result(spark, rows) == sorted(plain_components(rows), key=str)


def test_empty_table(spark):
    assert result(spark, []) == []


def test_dense_cell_in_blocks(spark):
    rng = random.Random(3)
    base = rng.getrandbits(64)
    fps = {base}
    while len(fps) < 300:
        x = rng.choice(sorted(fps))
        for _ in range(rng.randrange(1, 6)):
            x ^= 1 << rng.randrange(64)
        fps.add(x)
    signed = [(simhash._signed(x),) for x in fps]
    got = components(simhash.links(spark.createDataFrame(signed, "fp long"), block=16)).collect()
    root = {x: x for (x,) in signed} | {r["node"]: r["root"] for r in got}
    xs = np.array(sorted(root)).astype(np.int64).view(np.uint64)
    group = {x: x for x in xs.tolist()}
    changed = True
    near = [(a, b) for a in xs.tolist() for b in xs.tolist() if a < b and (a ^ b).bit_count() <= 3]
    while changed:
        changed = False
        for a, b in near:
            if group[a] != group[b]:
                low, high = sorted((group[a], group[b]))
                group = {k: low if g == high else g for k, g in group.items()}
                changed = True
    by = lambda pairs: sorted(sorted(k for k, g in pairs.items() if g == v) for v in set(pairs.values()))
    assert by({int(np.int64(k).view(np.uint64)): v for k, v in root.items()}) == by(group)


def test_links_are_a_forest(spark):
    fps = [(i,) for i in range(256)]  # all within 8 bits of each other
    assert simhash.links(spark.createDataFrame(fps, "fp long")).count() <= 20 * 255


def test_components_of_paths_and_nothing(spark):
    path = [(i, i + 1) for i in range(0, 200)] + [(500, 501), (7, 7), (None, 3)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(path, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 201)} | {501: 500}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_one_of_each(spark):
    rows = corpus(4, 60)
    df = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)
    out = simhash.one_of_each(df).collect()
    groups = {}
    for (i, fp, c), (_, t) in zip(plain_components(rows), rows, strict=True):
        groups.setdefault(c if c is not None else fp, []).append(i)
    want = sorted(min((i for i in g if i is not None), default=None) if any(i is not None for i in g) else None for g in groups.values() if any(i is not None for i in g))
    assert sorted(r["doc_id"] for r in out if r["doc_id"] is not None) == want
    assert sum(r["doc_id"] is None for r in out) == sum(all(i is None for i in g) for g in groups.values())
