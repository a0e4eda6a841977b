"""Blending several sentiment sources."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.basic import clip, or_zero
from ..functions.ordering import packed
from ..params import MoodParams


def composite(
    raw: DataFrame, keys: Sequence[str], order: Sequence[str], weights: dict[str, float]
) -> DataFrame:
    """Weighted mean over the first row of each known source, per key.

    One shuffle: the sources are a short fixed list, so the first row of each is a conditional
    aggregate and rows are reduced to one per key before they move.  Other sources are dropped.
    """
    known = raw.filter(F.col("source").isin(*weights))
    first = packed(raw, order)
    picks = []
    for s in weights:
        here = F.col("source") == s
        picks += [F.min_by(c, F.when(here, first)).alias(f"{s}_{c}") for c in ("score", "confidence")]
        picks.append(F.count_if(here).alias(f"{s}_n"))
    wide = known.groupBy(*keys).agg(*picks)
    wide = wide.select(*keys, *(F.struct(F.col(f"{s}_score").alias("score"), F.col(f"{s}_confidence").alias("confidence"),
                                         F.col(f"{s}_n").alias("n")).alias(s) for s in weights))
    present = {s: F.col(s)["n"] > 0 for s in weights}
    total = sum((F.when(present[s], w).otherwise(0.0) for s, w in weights.items()), F.lit(0.0))
    blended = sum((or_zero(F.col(s)["score"] * w) for s, w in weights.items()), F.lit(0.0))
    count = sum((present[s].cast("long") for s in weights), F.lit(0).cast("long"))
    trust = sum((or_zero(F.col(s)["confidence"]) for s in weights), F.lit(0.0))
    parts = F.filter(
        F.array(*(F.struct(F.lit(s).alias("k"), F.col(s)["score"].alias("v")) for s in weights)),
        lambda e: e["v"].isNotNull(),
    )
    return wide.filter(total > 0).select(
        *keys,
        (blended / total).alias("score"),
        (trust / count).alias("confidence"),
        count.alias("n_sources"),
        F.map_from_entries(parts).alias("source_scores"),
    )


def total_score(
    raw: DataFrame, keys: Sequence[str], order: Sequence[str], p: MoodParams = MoodParams()
) -> DataFrame:
    """Total on the five-point scale per key, the last row of each source winning.

    An unknown source has weight 0 and still shows in the maps.  Rows are first reduced to one per
    (key, source), so the maps hold one entry per source and never one per raw row.
    """
    last = raw.groupBy(*keys, "source").agg(*(F.max_by(c, packed(raw, order)).alias(c) for c in ("score", "confidence")))
    weight = F.lit(0.0)
    for s, w in p.weights.items():
        weight = F.when(F.col("source") == s, w).otherwise(weight)
    rows = last.select(*keys, "source", "score", "confidence", weight.alias("w"))
    entry = lambda v: F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("source"), v))))
    return (
        rows.groupBy(*keys)
        .agg(
            F.sum(F.col("score") * F.col("w")).alias("_s"),
            F.sum("w").alias("_w"),
            F.avg("confidence").alias("mean_confidence"),
            entry(F.col("score") * F.col("w") * 5).alias("source_scores"),
            entry(F.col("confidence")).alias("confidences"),
        )
        .withColumn(
            "total",
            clip(F.when(F.col("_w") > 0, F.col("_s") / F.col("_w")).otherwise(F.col("_s")) * 5, p.floor, p.ceiling),
        )
        .drop("_s", "_w")
    )
