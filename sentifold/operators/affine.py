"""Recurrences x -> a*x + b along the order of a key, for keys of any size."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _composed(scale: np.ndarray, add: np.ndarray) -> np.ndarray:
    """Values after each map of x -> scale * x + add, the first of which ignores x: maps compose in pairs, fours, ..."""
    step = 1
    while step < len(add):
        new_add, new_scale = add.copy(), scale.copy()
        new_add[step:] += scale[step:] * add[:-step]
        new_scale[step:] *= scale[:-step]
        scale, add, step = new_scale, new_add, 2 * step
    return add


def _walk(parts: list[str], a: str, b: str, out: str, start: str) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Scan sorted rows batch by batch; only the running value and its key outlive a batch."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, x = None, 0.0
        for pdf in batches:
            if pdf.empty:
                continue
            names = pdf[parts]
            fresh = (names != names.shift()).any(axis=1).to_numpy()
            first = tuple(names.iloc[0])
            fresh[0] = first != key
            p, q = pdf[a].to_numpy(float), pdf[b].to_numpy(float)
            # The map that leads from the value before the previous row to that before this one.
            scale, add = np.append(0.0, p[:-1]), np.append(x, q[:-1])
            scale[fresh], add[fresh] = 0.0, pdf[start].to_numpy(float)[fresh]
            values = _composed(scale, add)
            x = p[-1] * values[-1] + q[-1]
            key = tuple(names.iloc[-1])
            yield pdf.drop(columns=[start]).assign(**{out: values})

    return of


def affine_scan(
    df: DataFrame, keys: Sequence[str], idx: str, a: str, b: str, out: str, largest: int, stretch: int
) -> DataFrame:
    """Add ``out``: the value of the recurrence before each row, starting from 0 in each key.

    ``idx`` numbers the rows of a key from 0 and ``largest`` is the size of the largest key.  Keys up
    to ``stretch`` rows are walked whole.  Beyond it, rows are walked in stretches: the map of a stretch
    is composed first, the same scan over those maps gives the value at which each stretch starts.
    """
    parts, rows = list(keys), df.withColumn("_start", F.lit(0.0))
    if largest > stretch:
        number = f"_cut_{idx}"
        cut = df.withColumn(number, F.floor(F.col(idx) / stretch))
        parts = [*keys, number]
        # The composed map of a stretch: where it takes 0, and how it scales what comes in.
        zero = affine_scan(cut, parts, idx, a, b, "_x", stretch, stretch)
        last = zero.groupBy(*parts).agg(
            F.max_by(F.col(a) * F.col("_x") + F.col(b), idx).alias("_b"), F.product(a).alias("_a")
        )
        starts = affine_scan(last, keys, number, "_a", "_b", "_start", -(-largest // stretch), stretch)
        rows = cut.join(starts.select(*parts, "_start"), parts)
    schema = ", ".join(f"`{n}` {k}" for n, k in rows.dtypes if n != "_start") + f", `{out}` double"
    # By a hash of the parts: after a join on the parts themselves the shuffle would be left out as redundant, and adaptive
    # execution, to which the walk states no requirement, could then deal the rows of one part to several tasks.
    placed = rows.withColumn("_home", F.xxhash64(*parts)).repartition("_home").sortWithinPartitions(*parts, idx).drop("_home")
    walked = placed.mapInPandas(_walk(parts, a, b, out, "_start"), schema)
    return walked.drop(*parts[len(keys) :])
