"""Exact running totals along an ordered key, without a single-partition window.

The rows are range-partitioned on (group, key) by Spark's own sort and written to the
shared folder once, so the partition of a row is fixed. Each partition contributes its
totals; the prefix sums over those (at most partitions + groups rows) are broadcast back,
and a window only ever spans one partition of one group.

The key must be unique within its group: aggregate ties first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loanlab.session import durable


def running_totals(df: DataFrame, group, key: str, sums, ascending: bool = True,
                   following: bool = False) -> DataFrame:
    """Add ``cum_<s>`` (inclusive) and ``total_<s>`` for every column of ``sums``.

    ``following=True`` also adds ``next_<s>``: the value in the next row of the group.
    """
    group, sums = list(group), list(sums)
    direction = F.asc if ascending else F.desc
    placed = durable(df.orderBy(*group, direction(key))).withColumn("_part", F.spark_partition_id())

    first = F.min if ascending else F.max
    heads = placed.groupBy(*group, "_part").agg(
        *[F.sum(s).alias(f"_sum_{s}") for s in sums],
        first(F.struct(key, *sums)).alias("_head"))
    in_group = W.partitionBy(*group)
    ordered = in_group.orderBy("_part")
    before = ordered.rowsBetween(W.unboundedPreceding, -1)
    offsets = heads.select(
        *group, "_part",
        *[F.coalesce(F.sum(f"_sum_{s}").over(before), F.lit(0)).alias(f"_off_{s}") for s in sums],
        *[F.sum(f"_sum_{s}").over(in_group).alias(f"total_{s}") for s in sums],
        F.lead("_head").over(ordered).alias("_next_head"))
    # (group, part) pairs: ranges are contiguous, so at most partitions + groups rows
    joined = placed.join(F.broadcast(offsets), [*group, "_part"])
    w = W.partitionBy(*group, "_part").orderBy(direction(key))
    upto = w.rowsBetween(W.unboundedPreceding, W.currentRow)
    out = joined.select(
        *group, key, *sums,
        *[(F.sum(s).over(upto) + F.col(f"_off_{s}")).alias(f"cum_{s}") for s in sums],
        *[F.col(f"total_{s}") for s in sums],
        *([F.coalesce(F.lead(s).over(w), F.col(f"_next_head.{s}")).alias(f"next_{s}") for s in sums]
          if following else []))
    return out
