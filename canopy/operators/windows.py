"""Per-group ordering operators (E1-E4) that stay safe when one group is huge.

A plain ``Window.partitionBy(group)`` puts a whole group into one task.  The
helpers here bound that:

* top-n per group uses ``row_number() <= n``; Spark plans it with a partial
  ``WindowGroupLimit`` before the shuffle, so at most n rows per group and map
  task cross the network.
* the running sum cuts the ordering key into ranges of about equally many rows (split points
  from the data, so sparse or dense keys make no difference).  The per-row window spans one
  range of a group; the totals of ranges, at most ``MOST_RANGES`` a group, are prefix-summed
  in a second, small window and joined back as offsets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_n_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], n: int,
                      rank_col: str = "rn") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= n)


MOST_RANGES = 10_000


def range_splits(df: DataFrame, order_col: str, rows_each: int) -> list[float]:
    """Ascending split points that leave about ``rows_each`` rows between two of them (two small jobs)."""
    n = min(MOST_RANGES, df.count() // rows_each)
    if n < 2:
        return []
    points = df.agg(F.percentile_approx(order_col, [i / n for i in range(1, n)], 20 * n).alias("p")).first().p
    return sorted({float(p) for p in points or []})


def grouped_prefix_sum(df: DataFrame, keys: Sequence[str], order_col: str, value_col: str, out_col: str,
                       inclusive: bool = False, rows_each: int = 65_536) -> DataFrame:
    """Running sum of ``value_col`` per ``keys`` ordered by ``order_col``, a number.

    ``inclusive=False`` gives the sum over strictly earlier rows (an offset).
    """
    blk = "__blk"
    splits = range_splits(df, order_col, rows_each)
    if splits:
        df = df.withColumn("__at", F.col(order_col).cast("double"))
        df = Bucketizer(splits=[float("-inf"), *splits, float("inf")], inputCol="__at", outputCol=blk,
                        handleInvalid="keep").transform(df).drop("__at")
    else:
        df = df.withColumn(blk, F.lit(0.0))
    end = Window.currentRow if inclusive else -1
    w_in = Window.partitionBy(*keys, blk).orderBy(order_col).rowsBetween(Window.unboundedPreceding, end)
    within = df.withColumn("__within", F.coalesce(F.sum(value_col).over(w_in), F.lit(0)))
    if not splits:
        return within.withColumn(out_col, F.col("__within")).drop(blk, "__within")
    totals = df.groupBy(*keys, blk).agg(F.sum(value_col).alias("__bt"))
    w_b = Window.partitionBy(*keys).orderBy(blk).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, blk, F.coalesce(F.sum("__bt").over(w_b), F.lit(0)).alias("__boff"))
    return (within.join(offsets, [*keys, blk])
            .withColumn(out_col, F.col("__boff") + F.col("__within"))
            .drop(blk, "__within", "__boff"))
