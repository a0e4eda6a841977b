"""Near-duplicates against the shingle sets of all pairs."""

import random

import corpus_pipeline
from pyspark.sql import types as T

from sentifold.llm import resemblance

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("root", T.StringType())])


def plain_set(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_kept(rows):
    """Positions of the rows that come first in their group."""
    sets = [plain_set(t) for _, t in rows]
    group = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            common, union = len(a & b), len(a | b)
            if group[i] != group[j] and 5 * common >= 4 * union:
                x, y = group[i], group[j]
                group = [x if g == y else g for g in group]
    firsts = {}
    for n, ((i, _), g) in enumerate(zip(rows, group, strict=True)):
        place = (i is None, i or 0, n)
        firsts[g] = min(firsts.get(g, place), place)
    return sorted(p[2] for p in firsts.values())


def edited_copies(seed, n=60):
    """Texts, and copies of them (and of copies) with edits on both sides of the threshold."""
    rng = random.Random(seed)
    words = ["w%d" % i for i in range(500)]
    rows = []
    for i in rng.sample(range(10_000), n):
        own = rng.choices(words, k=rng.choice([1, 3, 5, 40, 100, 300]))
        rows.append((i, " ".join(own)))
        for k in range(rng.choice([0, 1, 4])):
            own = list(own)
            for _ in range(rng.randrange(1 + len(own) // 30)):
                own[rng.randrange(len(own))] = rng.choice(words)
            rows.append((10_000 + 10 * i + k, rng.choice([" ", "\n"]).join(own).title()))
    rng.shuffle(rows)
    return rows + [(90_000, None), (90_001, " \t\n"), (None, rows[0][1]), (None, "only null"), rows[3], rows[3], (90_002, "Long Text " * 40_000)]


def check(spark, rows, stage):
    df = spark.createDataFrame([(i, t, str(n)) for n, (i, t) in enumerate(rows)], SCHEMA).coalesce(1)
    out = stage(df)
    assert out.columns == df.columns
    assert sorted(int(r["root"]) for r in out.collect()) == plain_kept(rows)


def test_stage_finds_edited_copies(spark):
    check(spark, edited_copies(1), lambda df: corpus_pipeline.near_dedup(spark, df, ""))


def test_blocks_of_a_large_group(spark):
    check(spark, edited_copies(2, 30), lambda df: resemblance.one_of_each(df, block_bytes=1000))


def test_recall_at_the_threshold():
    rng = random.Random(3)
    missed = 0
    for _ in range(3000):
        common, a, b = ([rng.getrandbits(64) for _ in range(k)] for k in (80, 10, 10))
        sets = [resemblance.np.array(sorted(common + x), resemblance.np.uint64) for x in (a, b)]
        assert resemblance.similar(*sets)
        keys = resemblance.band_keys(sets)
        missed += not (keys[0] == keys[1]).any()
    assert missed <= 1


def test_empty_table(spark):
    assert resemblance.one_of_each(spark.createDataFrame([], SCHEMA)).collect() == []


def test_links_by_fingerprint_alone(spark):
    """Texts that share no key but lie within three bits are verified; unlike ones are not linked, however near their fingerprints."""
    words = ["w%d" % i for i in range(300)]
    texts = [words, [*words[:-1], "other"], ["x%d" % i for i in range(300)], words[:100], words]
    fps = [0b1011, 0b0001, 0b1010, 0b1011, 1 << 40 | 0b111111]
    docs = spark.createDataFrame([(n, " ".join(t).encode()) for n, t in enumerate(texts)], "row long, text binary")
    sets = spark.createDataFrame([(n, fp, [100 * n + k for k in range(32)]) for n, fp in enumerate(fps)], "row long, fp long, keys array<long>")
    assert {tuple(sorted(r)) for r in resemblance.links(sets, docs).collect()} == {(0, 1)}
