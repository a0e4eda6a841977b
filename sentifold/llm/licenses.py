"""License scans by diagonal voting, with DataFrame functions only.

Every rolling k-gram of words of a text is joined, by its hash, with the places of the k-grams of all templates; the
gram itself is compared too, so a vote is exact.  Votes of a document for a template lie on diagonals: place in
the text less place in the template.  Diagonals are counted, neighbouring ones (a word added or left out moves the
text to the next diagonal) are merged while their places touch, and a merged span is verified by the share of the
template's words that its grams cover.  Votes on far diagonals, such as a word pair of another place in the template,
stand in bands of their own and part nothing.

A phrase of the base must be covered whole on one diagonal: its words stand consecutively.  A notice needs
`COVER` of its words.  These templates are few and fixed, so they are broadcast.

A table of templates (label, text) may be given besides, such as whole licences.  Its grams have `LONG_GRAM` words, as
word pairs of a whole licence stand everywhere; it may have any size and is joined as adaptive execution sees fit.

Defined cases: a null text is empty; repeated rows give their own results; an empty table gives no rows; other columns are
ignored; a text of one word has no grams and matches nothing.  Templates without a label or of fewer words than a gram
match nothing; repeated templates count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

GRAM = 2
LONG_GRAM = 4
# Share of a notice's words that a span must hold, and how far apart its diagonals may lie.
COVER = 0.8
SHIFT = 3

# The base phrases and the label of each.
PHRASES = {
    "mit license": "mit",
    "apache license": "apache",
    "general public license": "gpl",
}

# Sentences of public licences and usual notices, and the label of each.
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit",
    "licensed under the apache license version 2 0": "apache",
    "you may not use this file except in compliance with the license": "apache",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu": "gpl",
    "licensed under the gnu general public license version 3": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "subject to the terms of the mozilla public license": "mpl",
    "this work is licensed under a creative commons attribution": "cc",
    "licensed under cc by": "cc",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "eclipse public license": "epl",
    "boost software license": "bsl",
}

# Word separators: ASCII characters that are neither letters nor digits, after lower-casing A-Z.
_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _templates(spark: SparkSession) -> DataFrame:
    """(template, label, base, size, width, place, gram, hash): one row per gram of each template, some hundred at most."""
    rows = [(label, True, phrase) for phrase, label in PHRASES.items()] + [(label, False, notice) for notice, label in NOTICES.items()]
    grams = []
    for n, (label, base, text) in enumerate(rows):
        words = text.split()
        grams += [(str(n), label, base, len(words), GRAM, i, " ".join(words[i : i + GRAM])) for i in range(len(words) - GRAM + 1)]
    names = ("template", "label", "base", "size", "width", "place", "gram")
    structs = [F.struct(*[F.lit(v).alias(n) for n, v in zip(names, g, strict=True)]) for g in grams]
    return spark.range(1).select(F.inline(F.array(*structs))).withColumn("hash", F.xxhash64("gram"))


def words(text: Column) -> Column:
    """The words of a text; splitting leaves an empty string before a leading and after a trailing separator."""
    return F.filter(F.split(F.translate(F.coalesce(text.cast("string"), F.lit("")), _CAPITALS, _CAPITALS.lower()), _SEPARATORS), lambda w: w != "")


def _rolling(found: Column, width: int) -> Column:
    """Every rolling gram of so many words, with its place."""
    gram = lambda i: F.concat_ws(" ", *[F.element_at(found, i + k + 1) for k in range(width)])
    places = F.when(F.size(found) >= width, F.sequence(F.lit(0), F.size(found) - width)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.struct(i.alias("at"), gram(i).alias("gram")))


def _grams(found: Column, widths: tuple[int, ...]) -> Column:
    """A first entry that stands for the document itself, then the rolling grams of each width."""
    itself = F.array(F.struct(F.lit(-1).alias("at"), F.size(found).cast("string").alias("gram")))
    return F.concat(itself, *[_rolling(found, width) for width in widths])


def _given(templates: DataFrame) -> DataFrame:
    """The grams of a table of templates, in the columns of `_templates`."""
    rows = templates.select(F.col("label").cast("string").alias("label"), words(F.col("text")).alias("words"))
    rows = rows.filter("label is not null").distinct()
    rows = rows.withColumn("template", F.sha2(F.to_json(F.struct("label", "words")), 256))
    grams = rows.select("template", "label", F.size("words").alias("size"), F.explode(_rolling(F.col("words"), LONG_GRAM)).alias("g"))
    out = grams.select(
        "template", "label", F.lit(False).alias("base"), "size", F.lit(LONG_GRAM).alias("width"), F.col("g.at").alias("place"), "g.gram"
    )
    return out.withColumn("hash", F.xxhash64("gram"))


def _parted(votes: DataFrame, keys: list[str], new: Column, by: str, name: str) -> DataFrame:
    """Numbers the runs, in the order of a column within a template's votes, that begin where `new` holds."""
    order = Window.partitionBy("row", "template", *keys).orderBy(by, "diagonal")
    votes = votes.withColumn("new_", F.when(F.coalesce(new, F.lit(False)), 1).otherwise(0))
    return votes.withColumn(name, F.sum("new_").over(order)).drop("new_")


def scanned(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", templates: DataFrame | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for every document."""
    known, widths = F.broadcast(_templates(docs.sparkSession)), (GRAM,)
    if templates is not None:
        known, widths = _templates(docs.sparkSession).unionByName(_given(templates)), (GRAM, LONG_GRAM)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), words(F.col(text)).alias("words"))
    grams = rows.select("row", "doc_id", F.explode(_grams(F.col("words"), widths)).alias("g")).select("row", "doc_id", "g.at", "g.gram")
    # A document's own entry has a hash of its own kind: one null for all would be a hot key where the join shuffles.
    met = grams.withColumn("hash", F.when(F.col("at") >= 0, F.xxhash64("gram")).otherwise(F.xxhash64("row", F.lit("itself"))))
    met = met.join(known.withColumnRenamed("gram", "gram_"), ["hash"], "left")
    met = met.withColumn("template", F.when((F.col("at") >= 0) & (F.col("gram") == F.col("gram_")), F.col("template")))
    met = met.filter("at < 0 or template is not null")

    # Votes by diagonal; the document's own entry is on none.
    votes = met.groupBy("row", "template", (F.col("at") - F.col("place")).alias("diagonal")).agg(
        F.first("doc_id").alias("doc_id"),
        F.first("label").alias("label"),
        F.first("base").alias("base"),
        F.first("size").alias("size"),
        F.first("width").alias("width"),
        F.max(F.when(F.col("at") < 0, F.col("gram").cast("long"))).alias("n_words"),
        F.min("at").alias("low"),
        F.max("at").alias("high"),
        F.collect_set("place").alias("places"),
    )
    # Neighbouring diagonals are a band, whose votes are parted where their places no longer touch; what this leaves apart
    # in diagonals is parted again.  No step parts two votes that are near in both.
    far = F.col("diagonal") - F.lag("diagonal").over(Window.partitionBy("row", "template").orderBy("diagonal")) > SHIFT
    spans = _parted(votes, [], F.col("base") | far, "diagonal", "band")
    before = Window.partitionBy("row", "template", "band").orderBy("low", "diagonal").rowsBetween(Window.unboundedPreceding, -1)
    spans = _parted(spans, ["band"], F.col("low") > F.max("high").over(before) + F.col("width") + SHIFT, "low", "part")
    near = Window.partitionBy("row", "template", "band", "part").orderBy("diagonal")
    spans = _parted(spans, ["band", "part"], F.col("diagonal") - F.lag("diagonal").over(near) > SHIFT, "diagonal", "span")
    spans = spans.groupBy("row", "template", "band", "part", "span").agg(
        F.first("doc_id").alias("doc_id"),
        F.first("label").alias("label"),
        F.first("base").alias("base"),
        F.first("size").alias("size"),
        F.first("width").alias("width"),
        F.max("n_words").alias("n_words"),
        F.min("diagonal").alias("diagonal"),
        F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"),
    )
    # The template's words that the span's grams hold.
    held = F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(p, p + F.col("width") - 1))))
    cover = F.when(F.col("template").isNotNull(), F.size(held) / F.col("size"))
    spans = spans.withColumn("cover", cover)
    is_base = F.col("base") & (F.col("cover") == 1)
    is_notice = ~F.col("base") & (F.col("cover") >= COVER)
    labels = lambda when: F.array_join(F.array_sort(F.collect_set(F.when(when, F.col("label")))), ",")
    return spans.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"),
        F.max("n_words").alias("n_words"),
        F.count(F.when(is_base, 1)).alias("n_base"),
        F.min(F.when(is_base, F.col("diagonal").cast("long"))).alias("first_word"),
        F.max(F.when(is_base, F.col("diagonal").cast("long"))).alias("last_word"),
        labels(is_base).alias("base_labels"),
        labels(is_base | is_notice).alias("labels"),
        F.coalesce(F.max(F.when(is_base | is_notice, F.col("cover"))), F.lit(0.0)).alias("score"),
    ).drop("row")
