"""Running sums that split a long partition into blocks.

A window over one key runs in one task. Here a key's rows are cut into blocks
that follow the order; block totals (few rows) get the window over the whole key,
and rows only a window over their block, so a key with a third of all rows still
spreads over the cluster.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STEP = 1024


def running_sum(df: DataFrame, keys: list[str], blocks: dict[str, Column], order: list, value: Column, name: str, inclusive: bool = False) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over the rows before each one (and itself, if inclusive).

    ``blocks`` are columns that grow with ``order``; sorting by them and then by
    ``order`` must be the same as sorting by ``order``.
    """
    cut = {f"__{k}": c for k, c in blocks.items()}
    df = df.withColumns(cut | {"__v": value})
    total = df.groupBy(*keys, *cut).agg(F.sum("__v").alias("__s"))
    w = Window.partitionBy(*keys).orderBy(*cut).rowsBetween(Window.unboundedPreceding, -1)
    ahead = total.withColumn("__before", F.coalesce(F.sum("__s").over(w), F.lit(0))).drop("__s")
    ahead = ahead.select(*(F.col(c).alias(f"__r{c}") for c in [*keys, *cut]), "__before")
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"__r{c}")) for c in [*keys, *cut]))
    df = df.join(ahead, same).drop(*(f"__r{c}" for c in [*keys, *cut]))
    inner = Window.partitionBy(*keys, *cut).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    return df.withColumn(name, F.col("__before") + F.coalesce(F.sum("__v").over(inner), F.lit(0))).drop("__before", "__v", *cut)


def step_of(c: str | Column) -> Column:
    return F.floor((F.col(c) if isinstance(c, str) else c) / STEP)


def sums_before(totals: DataFrame, outer: str, inner: str, value: str, name: str) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over all rows before each one, by (outer, inner).

    In two levels: rows get a window over their outer value, only the outer values' sums
    get one over the whole table. Nulls come first.
    """
    big = totals.groupBy(F.col(outer).alias("__o")).agg(F.sum(value).alias("__s"))
    ahead = Window.orderBy("__o").rowsBetween(Window.unboundedPreceding, -1)  # a row for each outer value
    big = big.select("__o", F.coalesce(F.sum("__s").over(ahead), F.lit(0)).alias("__ahead"))
    own = Window.partitionBy(outer).orderBy(inner).rowsBetween(Window.unboundedPreceding, -1)
    rows = totals.join(big, F.col(outer).eqNullSafe(F.col("__o")))
    return rows.withColumn(name, F.col("__ahead") + F.coalesce(F.sum(value).over(own), F.lit(0))).drop("__o", "__ahead")


def last_value_wins(rows: DataFrame, key: str, order: str, values: str = "value") -> DataFrame:
    """One row a key with the map of its updates: later maps replace equal names of earlier ones."""
    each = rows.select(key, order, F.explode(values).alias("__n", "__v"))
    got = each.groupBy(key, "__n").agg(F.max_by("__v", order).alias("__v"))
    return got.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("__n", "__v")))).alias(values))
