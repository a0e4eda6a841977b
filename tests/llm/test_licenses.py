"""License scans against a walk over the words of each text."""

import random
import re

from pyspark.sql import types as T

from sentifold.llm import licenses

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("label", T.StringType())])
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def base(text):
    words = WORD.findall(lowered(text))
    places, labels = [], set()
    for phrase, label in licenses.PHRASES.items():
        parts = phrase.split()
        for i in range(len(words)):
            if words[i : i + len(parts)] == parts:
                places.append(i)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def scan(spark, rows):
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], SCHEMA)
    return licenses.scanned(df).collect()


def test_base_phrases(spark):
    rng = random.Random(1)
    parts = ["MIT", "license", "License,", "Apache", "general", "Public", "é", "K", "x1", "--", "\n", "mit-license", "the", "É"]
    rows = [(i, " ".join(rng.choices(parts, k=rng.randrange(40)))) for i in range(300)]
    rows += [(900, None), (901, ""), (902, "mit"), (903, " ;mit license. "), (None, "MIT License"), (rows[0]), (rows[0])]
    rows += [(904, "word " * 50_000 + "apache license " * 500), (905, "general general public license public license")]
    out = scan(spark, rows)
    got = sorted(((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in out), key=str)
    assert got == sorted(((i, *base(t)) for i, t in rows), key=str)
    assert all(set(r["base_labels"].split(",")) <= set(r["labels"].split(",")) | {""} and 0 <= r["score"] <= 1 for r in out)


def test_notices(spark):
    notice = next(iter(licenses.NOTICES))
    words = notice.split()
    rows = [
        (1, f"Some text. {notice.upper()}, and so on"),
        (2, " ".join(words[:5] + ["really"] + words[5:])),
        (3, " ".join(words[:6] + words[7:])),
        (4, " ".join(words[:6])),
        (5, " ".join(words[:8] + ["other"] * 40 + words[8:])),
        (6, "Licensed under CC BY-NC 4.0."),
        (7, "GNU Lesser General Public License"),
        (8, "public license of a general kind"),
    ]
    out = {r["doc_id"]: (r["labels"], r["score"]) for r in scan(spark, rows)}
    assert [out[i][0] for i in range(1, 9)] == ["mit", "mit", "mit", "", "", "cc", "gpl,lgpl", ""]
    assert out[1][1] == 1 and licenses.COVER <= out[3][1] < 1 and out[4][1] == 0


def plain(text, template, width):
    """The best cover of a template's words by a connected set of diagonals, by a walk over all votes."""
    found, parts = WORD.findall(lowered(text)), WORD.findall(lowered(template))
    votes = {}
    for i in range(len(found) - width + 1):
        for k in range(len(parts) - width + 1):
            if found[i : i + width] == parts[k : k + width]:
                votes.setdefault(i - k, []).append(i)
    link = lambda a, b: abs(a - b) <= licenses.SHIFT and (
        max(min(votes[a]), min(votes[b])) <= min(max(votes[a]), max(votes[b])) + width + licenses.SHIFT
    )
    best, todo = 0.0, set(votes)
    while todo:
        group, front = set(), [todo.pop()]
        while front:
            d = front.pop()
            group.add(d)
            close = {e for e in todo if link(d, e)}
            todo -= close
            front += close
        held = {i - d + k for d in group for i in votes[d] for k in range(width)}
        best = max(best, len(held) / len(parts))
    return best


def test_words_of_other_places_part_nothing(spark):
    """Word pairs of the same and of other notices inserted anywhere: whatever a walk finds at `COVER` is found."""
    rng = random.Random(5)
    notices = list(licenses.NOTICES.items())
    pairs = [" ".join(n.split()[k : k + 2]) for n, _ in notices for k in range(len(n.split()) - 1)]
    rows, wanted = [], {}
    for i in range(400):
        notice, label = rng.choice(notices)
        parts = notice.split()
        for _ in range(rng.randrange(3)):
            at = rng.randrange(1, len(parts))
            parts[at:at] = rng.choice(pairs).split()
        text = " ".join(rng.choices(["lorem", "ipsum", "dolor", "the"], k=5) + parts + ["sit", "amet"])
        rows.append((i, text))
        wanted[i] = {x for n, x in notices if plain(text, n, licenses.GRAM) >= licenses.COVER}
    gpl = next(n for n in licenses.NOTICES if n.startswith("this program")).split()
    for i, pair in enumerate(("x y", "you can", "this program", "terms of"), 900):
        rows.append((i, " ".join(gpl[:9] + pair.split() + gpl[9:])))
        wanted[i] = {"gpl"}
    for r in scan(spark, rows):
        assert wanted[r["doc_id"]] <= set(r["labels"].split(",")), (rows[r["doc_id"]] if r["doc_id"] < 400 else r)
    assert sum(map(bool, wanted.values())) > 250


def test_given_templates(spark):
    rng = random.Random(6)
    vocabulary = [f"w{k}" for k in range(60)]
    whole = {f"lic{k}": " ".join(rng.choices(vocabulary, k=400)) for k in range(5)}
    templates = [*whole.items(), ("lic0", whole["lic0"]), (None, whole["lic1"] + " more"), ("short", "w1 w2 w3"), ("none", None)]
    table = spark.createDataFrame(templates, "label string, text string")
    rows = [(900, None), (901, ""), (902, "mit license"), (903, "w1 w2 w3")]
    for i in range(40):
        parts = whole[f"lic{i % 5}"].split()
        for _ in range(i % 8):
            at = rng.randrange(len(parts))
            parts[at : at + rng.randrange(2)] = rng.choices(vocabulary, k=rng.randrange(2))
        rows.append((i, " ".join(rng.choices(vocabulary, k=300) + (parts if i < 35 else parts[:250]) + rng.choices(vocabulary, k=300))))
    docs = spark.createDataFrame([(i, t, "clash") for i, t in rows], SCHEMA)
    got = {r["doc_id"]: set(r["labels"].split(",")) - {""} for r in licenses.scanned(docs, templates=table).collect()}
    assert len(got) == len(rows)
    for i, text in rows:
        best = {x for x, t in whole.items() if plain(text, t, licenses.LONG_GRAM) >= licenses.COVER}
        assert got[i] == (best if i < 900 else {"mit"} if i == 902 else set()), i
    assert all(got[i] == {f"lic{i % 5}"} for i in range(35)) and not any(got[i] for i in range(35, 40))
    empty = licenses.scanned(docs, templates=table.limit(0)).collect()
    assert {r["doc_id"]: r["labels"] for r in empty}[902] == "mit"


def test_empty_table(spark):
    assert scan(spark, []) == []
