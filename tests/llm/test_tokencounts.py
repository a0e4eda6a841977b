"""Counts from token files against the tokenizer and a plain walk."""

import random

import numpy as np
from pyarrow import fs
from pyspark.sql import types as T
from tokenizers import Tokenizer

from sentifold.llm import tokencounts as tc
from sentifold.llm.tokens import Encoder, public_path

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("file", T.StringType())])


def walk(ids):
    out, start = [], 0
    for i, x in enumerate(ids):
        if x == tc.END_ID:
            out.append((len(out), start, i - start, True))
            start = i + 1
    return out + [(len(out), start, len(ids) - start, False)] * (start < len(ids))


def test_documents(spark):
    rng = random.Random(1)
    words = ["the", "The", "naïve", "x<|endoftext|>y", "\n\n", "  two", "\x1c", " ", "a\tb", "12", "...", "  "]
    rows = [(i, " ".join(rng.choices(words, k=rng.randrange(30)))) for i in range(100)]
    rows += [(None, None), (7, ""), (8, "long text " * 30_000), rows[0], rows[0]]
    df = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)
    tokenizer = Tokenizer.from_file(public_path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    got = sorted(((r["doc_id"], r["n_tokens"]) for r in tc.document_counts(df).collect()), key=str)
    assert got == sorted(((i, len(tokenizer.encode(t or "", add_special_tokens=False).ids)) for i, t in rows), key=str)
    assert tc.document_counts(df.limit(0)).collect() == []


def test_blocks_and_groups(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tc, "GROUP", 3)
    rng = random.Random(2)
    want, files = [], []
    for n in (0, 1, 5, 64, 200, 333):
        for share in (0.0, 0.02, 0.5, 1.0):
            ids = [tc.END_ID if rng.random() < share else rng.randrange(100) for _ in range(n)]
            name = f"{tmp_path}/{n}-{share}.bin"
            fs.LocalFileSystem().open_output_stream(name).write(np.array(ids, tc.ID_TYPE).tobytes())
            files.append((str(tmp_path), name))
            want += [(name, *x) for x in walk(ids)]
    got = tc.counts(spark.createDataFrame(files, "store string, file string"), block_ids=7).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_encoder_equals_whole_texts():
    path = public_path("byte_bpe_50k.json")
    rng = random.Random(3)
    parts = ["a", "bc", " ", "  ", "\n", "\t", " ", "\x1c", "\x1d", "é", "!", "'s", "12", "<|endoftext|>", " ", "　", "中文"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(25))) for _ in range(3000)]
    for literal in (False, True):
        enc = Encoder(path, literal)
        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = literal
        for t, ids in zip(texts, enc.encode(texts), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids
