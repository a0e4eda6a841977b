"""The stages, each on what its predecessor kept, against plain Python."""

import random

import corpus_pipeline
from pyspark.sql import types as T
from tokenizers import Tokenizer

from sentifold.llm import decontam, packing, suffixes
from sentifold.llm.common import written
from sentifold.llm.tokens import public_path
from tests.llm import test_decontam, test_resemblance, test_suffixes

FOLDER = "/root/testdata/sf0.001"
SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("kept", T.StringType()),
    T.StructField("posterior", T.LongType()), T.StructField("row", T.LongType()), T.StructField("n_words", T.StringType()),
])
STAGES = ["quality rules", "simhash near-dedup", "suffix-array dedup", "benchmark decontamination", "best-fit packing"]


def prose(rng, n):
    return [rng.choice("aeiou") + "".join(rng.choices("bcdfghlmnprst", k=rng.randrange(3, 7))) for _ in range(n)]


def text_of(words):
    return "\n".join(" ".join(words[i : i + 13]) for i in range(0, len(words), 13))


def corpus(seed):
    """(documents, benchmark): clean texts, edited copies, shared and nested passages, leaks, junk, nulls, repeated rows."""
    rng = random.Random(seed)
    items = [(i, prose(rng, rng.randrange(25, 45))) for i in range(4)]
    docs = [prose(rng, 300) for _ in range(30)]
    for k in range(6):  # near copies, and texts that only share a lot
        docs.append(test_decontam.edited(rng, docs[k], 3))
        docs.append(test_decontam.edited(rng, docs[10 + k], 60))
    short, long_ = prose(rng, 53), prose(rng, 20)
    for k in range(3):
        docs.append(prose(rng, 100) + short + prose(rng, 90))
        docs.append(prose(rng, 80) + short + long_ + prose(rng, 120))
    for _, item in items:
        docs.append(prose(rng, 70) + item + prose(rng, 90))
        docs.append(prose(rng, 90) + test_decontam.edited(rng, item, 2) + prose(rng, 60))
        docs.append(prose(rng, 90) + test_decontam.edited(rng, item, 14) + prose(rng, 60))
    rows = [(i, text_of(w)) for i, w in zip(rng.sample(range(1000), len(docs)), docs)]
    rows += [rows[20], rows[20], (None, rows[21][1]), (None, text_of(prose(rng, 150)))]
    rows += [(2000, None), (2001, ""), (2002, "too short"), (2003, "spam spam eggs " * 60), (2004, text_of(prose(rng, 4000)))]
    rng.shuffle(rows)
    return rows, [(i, " ".join(w)) for i, w in items]


def plain_quality(rows):
    def failed(text):
        words = (text or "").split()
        windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        seen = {w for w in windows if windows.count(w) > 1} if len(words) < 1000 else set()
        covered = {i + k for i, w in enumerate(windows) if w in seen for k in range(3)}
        return len(words) < 50 or 100 * len(covered) > 50 * len(words)

    return [r for r in rows if not failed(r[1])]


def plain_passages(rows):
    found, out = test_suffixes.plain(rows), []
    for n, (i, text) in enumerate(rows):
        gone = {w for low, high in found.get(n, ([], []))[1] for w in range(low, high)}
        words = [w for k, w in enumerate(text.split()) if k not in gone]
        if words:
            out.append((i, " ".join(words)))
    return out


def plain_leaks(rows, items):
    def leaks(text):
        words = decontam.words_of(text.encode())
        return any(test_decontam.distance(w, words) <= int(0.2 * len(w) + 1e-9) for w in (decontam.words_of(t.encode()) for _, t in items))

    return [r for r in rows if not leaks(r[1])]


def flat(rows):
    """Ids and words: cutting leaves the white space as it was."""
    return sorted(((i is None, i or 0, " ".join(t.split())) for i, t in rows))


def stored(spark, folder, rows, items):
    frame = spark.createDataFrame([(i, t, "mine", 7, 8, "nine") for i, t in rows], SCHEMA)
    frame.coalesce(1).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").coalesce(1).write.parquet(f"{folder}/benchmark.parquet")
    return spark.read.parquet(f"{folder}/documents.parquet")


def test_stages_against_plain_python(spark, tmp_path):
    rows, items = corpus(1)
    docs = stored(spark, tmp_path, rows, items)
    assert [n for n, _ in corpus_pipeline.STAGES] == STAGES
    wanted = [
        plain_quality, lambda r: [r[n] for n in test_resemblance.plain_kept(r)], plain_passages, lambda r: plain_leaks(r, items),
    ]
    sizes = [len(rows)]
    for (name, stage), plain in zip(corpus_pipeline.STAGES[:-1], wanted, strict=True):
        docs = written(stage(spark, docs, str(tmp_path)), name.replace(" ", "-"))
        assert docs.columns == SCHEMA.names
        kept = docs.collect()
        assert {(r["kept"], r["posterior"], r["row"], r["n_words"]) for r in kept} == {("mine", 7, 8, "nine")}
        rows = plain(rows)
        assert flat((r["doc_id"], r["text"]) for r in kept) == flat(rows)
        rows = [(r["doc_id"], r["text"]) for r in sorted(kept, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0))]
        sizes.append(len(rows))
    assert sizes[0] > sizes[1] > sizes[2] >= sizes[3] > sizes[4]
    pieces = corpus_pipeline.packed(spark, docs, str(tmp_path)).collect()
    tokenizer = Tokenizer.from_file(public_path("byte_bpe_50k.json"))
    lengths = sorted(len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for _, t in rows)
    per_row, sequences = {}, {}
    for p in pieces:
        per_row.setdefault((p["doc_id"]), []).append(p["length"])
        sequences.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    assert sum(map(sum, per_row.values())) == sum(lengths) and max(lengths) > 1024
    for places in sequences.values():
        ends = [a + n for a, n in sorted(places)]
        assert [a for a, _ in sorted(places)] == [0, *ends[:-1]] and ends[-1] <= 1024
    room: list[int] = []
    for n in sorted((p["length"] for p in pieces), reverse=True):
        fit = [k for k, r in enumerate(room) if r >= n]
        k = min(fit, key=lambda k: room[k]) if fit else len(room)
        room[k : k + 1] = [(room[k] if fit else 1024) - n]
    assert packing.lower_bound({n: [p["length"] for p in pieces].count(n) for n in {p["length"] for p in pieces}}, 1024) <= len(sequences) <= len(room)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(pieces)


def test_empty_table(spark, tmp_path):
    stored(spark, tmp_path, [], [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_given_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = written(stage(spark, docs, FOLDER), name.replace(" ", "-"))
        assert docs.columns == names
    assert all(r["n_chars"] == len(r["text"]) for r in docs.collect())
    assert suffixes.repeated(docs).filter("size(copies) > 0").count() == 0
