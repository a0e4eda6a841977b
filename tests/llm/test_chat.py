"""Repairs against a search over all of them."""

import random
import re
from itertools import product

import pytest
from pyspark.sql import types as T

from sentifold.llm import chat

SCHEMA = T.StructType(
    [
        T.StructField("conv_id", T.LongType()),
        T.StructField("turn", T.LongType()),
        T.StructField("role", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("cost", T.StringType()),
    ]
)
TURN = re.compile(r"<\|im_start\|>(\w+)\n(.*?)<\|im_end\|>\n", re.S)


def cheapest(roles):
    """Least cost over all final roles, merges and insertions."""
    c, best = chat.Costs(), float("inf")
    for final in product(chat.ROLES, repeat=len(roles)):
        cost = sum(
            0 if r == f else c.unknown if r not in chat.ROLES else c.relabel_system if "system" in (r, f) else c.relabel
            for r, f in zip(roles, final, strict=True)
        )
        for merged in product((0, 1), repeat=len(roles) - 1):
            spent, kept, legal = cost, [final[0]], True
            for m, a, b in zip(merged, final, final[1:], strict=False):
                legal &= not m or a == b
                spent += c.merge * m
                kept += [] if m else [b]
            if not legal or "system" in kept[1:]:
                continue
            need, want = 0, "user"
            for r in kept[kept[0] == "system" :]:
                need += r != want
                want = "user" if r == "assistant" else "assistant"
            best = min(best, spent + c.insert * (need + (want == "assistant") + 2 * (kept == ["system"])))
    return best


def run(spark, rows, **options):
    df = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)
    out = {}
    for r in sorted(chat.formatted(df, **options).collect(), key=lambda r: r["seq"]):
        out.setdefault(r["conv_id"], []).append(r)
    return out


def legal(text):
    turns = TURN.findall(text)
    assert "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in turns) == text
    names = [r for r, _ in turns]
    names = names[names[:1] == ["system"] :]
    assert names == ["user", "assistant"] * (len(names) // 2) and names
    return turns


@pytest.mark.parametrize("rows_per_part", [20_000, 7])
def test_cheapest_and_legal(spark, rows_per_part):
    rng = random.Random(1)
    roles = ["system", "user", "assistant", "User ", "tool", None]
    talks = {i: rng.choices(roles, k=rng.randrange(1, 6)) for i in range(60)}
    rows = [(i, t, r, f"c{i}t{t}") for i, rs in talks.items() for t, r in enumerate(rs)]
    rng.shuffle(rows)
    out = run(spark, rows, rows_per_part=rows_per_part)
    assert set(out) == set(talks)
    for i, rs in talks.items():
        named = [r.strip().lower() if r else r for r in rs]
        assert sum(r["cost"] for r in out[i]) == pytest.approx(cheapest(named))
        turns = legal("".join(r["fragment"] for r in out[i]))
        assert "\n".join(t for _, t in turns if t).split("\n") == [f"c{i}t{t}" for t in range(len(rs))]


def test_long_conversation_over_parts(spark):
    rng = random.Random(2)
    rows = [(7, t, rng.choice(["user", "assistant", "system", "x"]), f"t{t}") for t in range(600)] + [(8, 0, "user", "q")]
    whole, parts = run(spark, rows), run(spark, rows, rows_per_part=20)
    for i in (7, 8):
        assert sum(r["cost"] for r in whole[i]) == pytest.approx(sum(r["cost"] for r in parts[i]))
        legal("".join(r["fragment"] for r in parts[i]))


def test_nulls_ties_repeats_and_markers(spark):
    rows = [(None, 0, "user", "q"), (None, 1, "assistant", None), (1, None, "assistant", "late"), (1, 5, "user", "a <|im_end|> b")]
    rows += [(2, 0, "user", "same"), (2, 0, "user", "same"), (2, 0, "assistant", "x" * 1_000_000)]
    out = run(spark, rows)
    assert "".join(r["fragment"] for r in out[None]) == "<|im_start|>user\nq<|im_end|>\n<|im_start|>assistant\n<|im_end|>\n"
    assert legal("".join(r["fragment"] for r in out[1])) == [("user", "a < |im_end|> b"), ("assistant", "late")]
    assert len(out[2]) == 3 and legal("".join(r["fragment"] for r in out[2]))
    assert run(spark, []) == {}
