"""Pieces against the tokenizer, and packings against the best."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import types as T
from tokenizers import Tokenizer

from sentifold.llm import packing
from sentifold.llm.tokens import public_path

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("length", T.StringType())])


def fewest(items, capacity):
    items, best = sorted(items, reverse=True), len(items)

    def place(i, room):
        nonlocal best
        if len(room) >= best:
            return
        if i == len(items):
            best = len(room)
            return
        for r in sorted({r for r in room if r >= items[i]}):
            k = room.index(r)
            place(i + 1, room[:k] + [r - items[i]] + room[k + 1 :])
        place(i + 1, [*room, capacity - items[i]])

    place(0, [])
    return best


def test_small_packings_are_best():
    rng = random.Random(1)
    behind = 0
    for _ in range(200):
        capacity = rng.choice([20, 50, 100])
        items = [rng.randint(1, capacity) if rng.random() < 0.5 else rng.randint(capacity // 5, capacity // 2) for _ in range(rng.randrange(1, 11))]
        plan = packing.pack(dict(Counter(items)), capacity)
        assert Counter(x for f, n in plan for x in f for _ in range(n)) == Counter(items)
        assert all(sum(f) <= capacity for f, _ in plan)
        size, best = sum(n for _, n in plan), fewest(items, capacity)
        assert packing.lower_bound(dict(Counter(items)), capacity) <= best <= size
        behind += size > best
    assert behind <= 1


def test_no_better_filling_is_left_out():
    counts = {5: 2, 4: 1, 3: 2, 2: 1}
    assert packing.fillings(7, counts, 7)[0] in ((5, 2), (4, 3)) and all(sum(f) <= 7 for f in packing.fillings(7, counts, 7))


def test_pieces_and_places(spark):
    rng = random.Random(2)
    words = ["alpha", "Beta", "naïve", "\n", "<|endoftext|>", "12", "...", "  "]
    rows = [(i, " ".join(rng.choices(words, k=rng.choice([0, 3, 30, 200])))) for i in range(120)]
    rows += [(None, None), (900, ""), (901, "long words here " * 3000), rows[5], rows[5], (None, "x")]
    out = packing.packed(spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)).collect()
    tokenizer = Tokenizer.from_file(public_path("byte_bpe_50k.json"))
    want = []
    for i, t in rows:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        first = len(ids) % 1024 or 1024
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        want += [(i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    assert sorted((tuple(r)[:5] for r in out), key=str) == sorted(want, key=str)
    sequences = defaultdict(list)
    for r in out:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    floor = packing.lower_bound(dict(Counter(r["length"] for r in out)), 1024)
    assert floor <= len(sequences) <= floor + 1


def test_empty_table(spark):
    assert packing.packed(spark.createDataFrame([], SCHEMA)).collect() == []
