"""Star schema: dimensions with hashed surrogate keys, a fact table, rollups.

A surrogate key is the first 15 hex digits of the md5 of the natural key, so fact and dimension
compute it alone and the fact needs no join to get it. Distinct natural keys that share a
surrogate would mix members: every dimension is checked for that when it is built. Rows
whose natural key is entirely null belong to the unknown member, key 0.

Defined results: nulls inside a natural key are told apart from empty texts; repeated rows stay
in the fact and are folded in dimensions; an empty table gives dimensions with the unknown member only.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanlab.session import durable

UNKNOWN = 0


class KeyCollision(ValueError):
    """Two members of a dimension have the same surrogate key."""


def _text(c: str) -> Column:
    """A part of a natural key as text; null differs from every text."""
    x = F.col(c).cast("string")
    return F.when(x.isNull(), "-").otherwise(F.concat(F.lit("+"), x))


def surrogate_key(columns: Iterable[str]) -> Column:
    """The key of a member, from its natural key; ``UNKNOWN`` if all parts are null."""
    columns = list(columns)
    digest = F.substring(F.md5(F.concat_ws("\x1f", *[_text(c) for c in columns])), 1, 15)
    known = F.conv(digest, 16, 10).cast("bigint")
    nothing = F.lit(True)
    for c in columns:
        nothing &= F.col(c).isNull()
    return F.when(nothing, F.lit(UNKNOWN).cast("bigint")).otherwise(known)


def dimension(df: DataFrame, key: str, natural: Iterable[str], derived: dict[str, Column] | None = None,
              attributes: Iterable[str] = ()) -> DataFrame:
    """(key, natural..., attributes..., derived...): one row per member, the unknown one always among them.

    ``attributes`` follow from the natural key; if a member's rows disagree, the largest values
    (as one tuple) count. ``derived`` are expressions over the other columns.
    """
    natural, attributes, derived = list(natural), list(attributes), derived or {}
    folded = df.groupBy(*natural).agg(F.max(F.struct(*attributes, F.lit(0).alias("_"))).alias("_a"))
    members = folded.select(surrogate_key(natural).alias(key), *natural, *[F.col(f"_a.{a}").alias(a) for a in attributes])
    members = members.where(F.col(key) != UNKNOWN)
    twice = members.groupBy(key).count().where("count > 1").limit(1).collect()
    if twice:
        raise KeyCollision(f"{key} {twice[0][key]} stands for several members")
    nobody = df.sparkSession.range(1).select(
        F.lit(UNKNOWN).cast("bigint").alias(key),
        *[F.lit(None).cast(df.schema[c].dataType).alias(c) for c in natural + attributes])
    return members.unionByName(nobody).select("*", *[c.alias(n) for n, c in derived.items()])


def fact(df: DataFrame, keys: dict[str, list[str]], measures: Iterable[str]) -> DataFrame:
    """(one surrogate key per dimension, measures...): a projection of the rows, no join."""
    return df.select(*[surrogate_key(natural).alias(k) for k, natural in keys.items()], *measures)


def orphans(facts: DataFrame, dimensions: dict[str, DataFrame]) -> DataFrame:
    """(key, n): fact rows whose member is missing from the dimension; no rows if all are whole."""
    facts, out = durable(facts.select(*dimensions)), None  # every key reads the facts
    for key, members in dimensions.items():
        # keys are counted first: the join sees each member once, however many rows it has
        held = facts.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
        lost = held.join(members, key, "left_anti").agg(F.sum("n").alias("n")).where("n > 0").select(
            F.lit(key).alias("key"), "n")
        out = lost if out is None else out.unionByName(lost)
    return out


def rollup(rows: DataFrame, levels: Iterable[str], measures: dict[str, Column]) -> DataFrame:
    """(levels..., level, measures...) for every prefix of the levels; ``level`` counts the levels in use.

    ``level`` tells a subtotal from a member whose value is null.
    """
    levels = list(levels)
    depth = F.lit(len(levels)) - sum((F.grouping(c).cast("int") for c in levels), F.lit(0))
    return rows.rollup(*levels).agg(depth.alias("level"), *[c.alias(n) for n, c in measures.items()])
