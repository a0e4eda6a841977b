"""The first later row of a series that meets a condition of the asking row, however far ahead it lies.

Rows are numbered within their key; ``FAN`` consecutive rows make a node, ``FAN`` nodes a node of the next
level, and so on.  A node keeps the extremes of its rows, and as each condition compares one value with one bound, the
extremes tell whether some row below meets it.  An asking row searches the rest of its node, then the rest of the node above,
until a node holds a hit, and then goes down to the row: two equi-joins per level, each with at most
``FAN`` entries per row, instead of one row per pair.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .asof import asof_join
from .durable import durable
from .segments import ordered, positions

FAN = 64

Extremes = Callable[[str], Column]


def first_hit(
    asking: DataFrame,
    rows: DataFrame,
    key: str,
    order: str,
    values: Sequence[str],
    hit: Callable[[Extremes, Extremes], Column],
    tie: Sequence[str],
    limit: int | None = None,
    fan: int = FAN,
) -> DataFrame:
    """Give each asking row ``found``: the first row after its ``order`` with a hit (a struct of ``rows``' columns) or NULL.

    ``hit(low, high)`` is a condition on asking columns and on the least and greatest of ``values``; it must
    hold for a set of rows exactly if it holds for one of them.  ``rows`` has one row per key and order.
    """
    payload = [c for c in rows.columns if c != key]
    placed = positions(ordered(rows, [key], [order], limit), "_id").rows()
    leaf = placed.select(
        key,
        "_id",
        *(F.col(v).alias(f"_low_{v}") for v in values),
        *(F.col(v).alias(f"_high_{v}") for v in values),
        F.struct(*payload).alias("_row"),
    )
    leaf = durable(leaf)
    most = leaf.agg(F.max("_id")).first()[0]
    bounds = [f"_{side}_{v}" for v in values for side in ("low", "high")]

    # kids[k]: per node of level k + 1 its children of level k, in order.
    kids, nodes, width = [], leaf, fan
    while True:
        extra = ["_row"] if not kids else []
        child = F.struct("_id", *bounds, *extra)
        up = nodes.groupBy(key, F.floor(F.col("_id") / fan).alias("_node")).agg(
            F.sort_array(F.collect_list(child)).alias("_kids"),
            *(F.min(b).alias(b) if b.startswith("_low") else F.max(b).alias(b) for b in bounds),
        )
        up = durable(up)
        kids.append(up.select(F.col(key).alias("_key"), "_node", "_kids"))
        if most is None or width > most:
            break
        nodes, width = up.select(key, F.col("_node").alias("_id"), *bounds), width * fan

    spots = asof_join(asking, placed.select(key, order, F.col("_id").alias("_last")), [key], order, "_last", tie, True, limit)
    state = spots.withColumn("_from", F.coalesce(F.col("_last") + 1, F.lit(0)).cast("long")).drop("_last")
    state = state.withColumns({"_at": F.lit(None).cast("long"), "_level": F.lit(None).cast("int")})

    def first_kid(start: Column) -> Column:
        meets = lambda k: (k["_id"] >= start) & F.coalesce(
            hit(lambda v: k[f"_low_{v}"], lambda v: k[f"_high_{v}"]), F.lit(False)
        )
        return F.try_element_at(F.filter("_kids", meets), F.lit(1))

    def look(state: DataFrame, level: int, node: Column, start: Column, wanted: Column) -> DataFrame:
        asked = state.withColumn("_node_at", F.when(wanted, node))
        met = asked.join(kids[level], (F.col(key) == F.col("_key")) & (F.col("_node_at") == F.col("_node")), "left")
        return met.withColumn("_kid", first_kid(start)).drop("_key", "_node", "_kids", "_node_at")

    for level in range(len(kids)):  # up, until a node holds a hit
        open_ = F.col("_at").isNull()
        state = look(state, level, F.floor(F.col("_from") / fan), F.col("_from"), open_)
        state = state.withColumns(
            {
                "_level": F.when(open_ & F.col("_kid").isNotNull(), level).otherwise(F.col("_level")),
                "_at": F.coalesce("_at", "_kid._id"),
                "_from": F.floor(F.col("_from") / fan) + 1,
                **({"found": F.col("_kid._row")} if level == 0 else {}),
            }
        ).drop("_kid")
    for level in range(len(kids) - 2, -1, -1):  # down, to the row
        above = F.col("_level") > level
        state = look(state, level, F.col("_at"), F.lit(0), above)
        state = state.withColumn("_at", F.when(above, F.col("_kid._id")).otherwise(F.col("_at")))
        if level == 0:
            state = state.withColumn("found", F.coalesce("found", "_kid._row"))
        state = state.drop("_kid")
    return state.drop("_at", "_level", "_from")
