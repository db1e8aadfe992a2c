"""Versions of slowly changing rows, and facts joined to the version valid at their time.

Both need the row before, in the order of key and time. A window over the key would bring
all rows of a key into one task, and a join of facts with validity ranges would compare every
fact of a key with every version. Instead the rows are range-partitioned by (key, time)
once, so a key with very many rows spreads over partitions, and a window looks back inside
one partition only. What a partition's first rows need from before it is its predecessor's last
row: one row per partition is broadcast, whatever the number of keys.

Defined results: keys, times and attributes may be null; a null key is a key of its own, rows with a
null time are older than all others; a change to or from null is a change; equal rows and ties are
resolved by the stated order; empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loanlab.session import durable


def _placed(df: DataFrame, order: list) -> tuple[DataFrame, list]:
    """The rows, range-partitioned and stored, with their partition ``_part`` and place ``_at`` in it."""
    placed = durable(df.orderBy(*order)).withColumn("_part", F.spark_partition_id())
    return placed, order


def with_before(df: DataFrame, order: list, what: Column) -> DataFrame:
    """Adds ``_before``: ``what`` of the row just before in the given order, null for the first row."""
    placed, order = _placed(df.withColumn("_what", what), order)
    inside = W.partitionBy("_part").orderBy(*order)
    lagged = placed.withColumn("_row", F.row_number().over(inside)).withColumn(
        "_lag", F.lag("_what").over(inside))
    # the last row of each partition that has rows, and which partition comes next: one row each
    last = lagged.groupBy("_part").agg(F.max_by("_what", "_row").alias("_carry"))
    one = W.orderBy("_part")
    carried = last.select("_part", F.lag("_carry").over(one).alias("_carried"))
    return (lagged.join(F.broadcast(carried), "_part")
            .withColumn("_before", F.when(F.col("_row") == 1, F.col("_carried")).otherwise(F.col("_lag")))
            .drop("_part", "_row", "_lag", "_carried", "_what"))


def with_last_known(df: DataFrame, order: list, what: Column) -> DataFrame:
    """Adds ``_known``: the last ``what`` that is not null, up to and with the row itself."""
    placed, order = _placed(df.withColumn("_what", what), order)
    inside = W.partitionBy("_part").orderBy(*order)
    upto = inside.rowsBetween(W.unboundedPreceding, W.currentRow)
    seen = placed.withColumn("_row", F.row_number().over(inside)).withColumn(
        "_seen", F.last("_what", ignorenulls=True).over(upto))
    last = seen.groupBy("_part").agg(F.max_by("_seen", "_row").alias("_carry"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    carried = last.select("_part", F.last("_carry", ignorenulls=True).over(before).alias("_carried"))
    return (seen.join(F.broadcast(carried), "_part").withColumn("_known", F.coalesce("_seen", "_carried"))
            .drop("_part", "_row", "_seen", "_carried", "_what"))


def _same(a, b) -> Column:
    return a.eqNullSafe(b)


def versions(df: DataFrame, key: str, time: str, attributes, tie) -> DataFrame:
    """(key, attributes..., valid_from, valid_to, is_current): one row per stretch of equal attributes.

    Of several rows of a key at one time the one with the largest ``tie`` (then the largest
    attributes) counts. A version is
    valid from its first row up to, not with, ``valid_to``; the current one has none.
    """
    attributes = list(attributes)
    state = F.struct(*[F.col(a) for a in attributes])
    at_once = df.groupBy(key, time).agg(F.max(F.struct(F.col(tie).alias("t"), state.alias("s"))).alias("m")).select(
        F.col(key).alias("_key"), F.col(time).alias("_time"), F.col("m.s").alias("_state"))
    seen = with_before(at_once, [F.col("_key").asc_nulls_first(), F.col("_time").asc_nulls_first()],
                       F.struct("_key", "_state"))
    changed = (F.col("_before").isNull() | ~_same(F.col("_before._key"), F.col("_key"))
               | ~_same(F.col("_before._state"), F.col("_state")))
    starts = seen.where(changed).drop("_before")
    # the version after: the row before, seen from the other end
    ended = with_before(starts, [F.col("_key").desc_nulls_last(), F.col("_time").desc_nulls_last()],
                        F.struct("_key", "_time"))
    same_key = F.col("_before").isNotNull() & _same(F.col("_before._key"), F.col("_key"))
    return ended.select(F.col("_key").alias(key), *[F.col(f"_state.{a}").alias(a) for a in attributes],
                        F.col("_time").alias("valid_from"), F.when(same_key, F.col("_before._time")).alias("valid_to"),
                        (~same_key).alias("is_current"))


def as_of(facts: DataFrame, dimension: DataFrame, key: str, time: str, attributes, keep=()) -> DataFrame:
    """(keep..., key, time, valid_from, attributes...): each fact with the version valid at its time.

    ``dimension`` is what ``versions`` gives. A version holds from ``valid_from`` on; facts
    before their key's first version, and of unknown keys, get nulls. Facts are kept one by one; those of
    one key and time are ordered by a hash, so that even they spread over partitions.
    """
    attributes, keep = list(attributes), list(keep)
    version = F.struct(F.col(key).alias("key"), F.col("valid_from"), *[F.col(a) for a in attributes])
    fact = F.struct(*[F.col(k) for k in keep])
    right = dimension.select(F.col(key).alias("_key"), F.col("valid_from").alias("_time"), F.lit(0).alias("_kind"),
                             version.alias("_version"))
    left = facts.select(F.col(key).alias("_key"), F.col(time).alias("_time"), F.lit(1).alias("_kind"),
                        fact.alias("_fact"), F.xxhash64(fact).alias("_spread"))
    both = right.unionByName(left, allowMissingColumns=True)
    known = with_last_known(both, [F.col("_key").asc_nulls_first(), F.col("_time").asc_nulls_first(), F.col("_kind"),
                                   F.col("_spread")], F.col("_version"))
    mine = F.when(_same(F.col("_known.key"), F.col("_key")), F.col("_known"))
    return known.where("_kind = 1").select(
        *[F.col(f"_fact.{k}").alias(k) for k in keep], F.col("_key").alias(key), F.col("_time").alias(time),
        mine["valid_from"].alias("valid_from"), *[mine[a].alias(a) for a in attributes])
