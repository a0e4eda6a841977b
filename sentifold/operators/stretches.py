"""Windows with a bounded look-back over keys of any size."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .segments import ROWS_PER_TASK, ordered, positions

POSITION = "position"
_STRETCH, _HOME = "_stretch", "_home"


def in_stretches(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    back: int,
    work: Callable[[DataFrame, list[str]], DataFrame],
    limit: int | None = None,
    first: Callable[[DataFrame, list[str]], DataFrame] | None = None,
) -> DataFrame:
    """Apply ``work(rows, keys)``, whose results look at most ``back`` rows behind each row.

    While every key is small this is ``work`` itself.  Otherwise each key is cut into stretches of
    equal length by the exact position of its rows, the last ``back`` rows of a stretch are handed
    to the next one as well, ``work`` runs per stretch, and those extra rows are dropped again.
    ``work`` sees the position of a row within its key as ``position``.

    ``first(rows, keys)`` comes before the cut, for columns that look back on a whole key; it is given the positions and must
    itself hold no whole key in a task.
    """
    rows = ordered(df, keys, order, limit)
    placed = positions(rows, POSITION).rows()
    if first is not None:
        placed = first(placed, list(keys))
    if not rows.split:
        return work(placed, list(keys)).drop(POSITION)
    size = max(ROWS_PER_TASK if limit is None else limit, 4 * back)
    home = F.floor(F.col(POSITION) / size)
    lent = F.col(POSITION) % size >= size - back
    copies = placed.withColumn(
        _STRETCH, F.explode(F.when(lent, F.array(home, home + 1)).otherwise(F.array(home)))
    ).withColumn(_HOME, F.col(_STRETCH) == home)
    done = work(copies, [*keys, _STRETCH])
    return done.filter(_HOME).drop(_HOME, _STRETCH, POSITION)
