"""Shard placement by a permutation-filled lookup table.

Every shard has a preference order over the slots of a table of prime size M: it starts at
an offset and steps by a skip, both taken from a digest of its name. Shards take turns, and
each claims its first slot that is still free, until the table is full. Shares differ by at
most one turn, and when a shard leaves few other slots change hands. A row's slot is its
key's digest modulo M; the table, M rows of one int and one name, is broadcast (its size is
fixed by the parameter and checked), so placing a row takes constant time and no shuffle.

Defined results: a null key counts as a key of its own (all such rows share one shard);
equal keys share a shard; repeated rows come out as they came in; an empty table gives no
rows; other columns are ignored unless kept, and a kept column with the name of a result
column gives way to it.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loanlab.llm.common import col, kept

TABLE_SIZE = 65_537     # a prime well above 100 times the shards
MOST_SLOTS = 1_000_003  # bounds the broadcast: some tens of megabytes
_NULL_KEY = "\x00null"


def _prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n ** 0.5) + 1))


def preference(shard: str, size: int) -> tuple[int, int]:
    """(offset, skip) of a shard's preference order: offset + turn * skip modulo the size."""
    digest = hashlib.md5(shard.encode()).hexdigest()
    return int(digest[:12], 16) % size, int(digest[12:24], 16) % (size - 1) + 1


def fill(shards: list[str], size: int = TABLE_SIZE) -> list[int]:
    """The number of the shard that holds each slot. Work is size x log(size) on average."""
    if not _prime(size) or size > MOST_SLOTS:
        raise ValueError(f"table size must be a prime of at most {MOST_SLOTS}")
    if not shards or len(set(shards)) != len(shards) or len(shards) > size:
        raise ValueError("shards must be distinct names, at least one and no more than slots")
    steps = [preference(s, size) for s in shards]
    at = [offset for offset, _ in steps]
    table, left = [-1] * size, size
    while left:
        for i, (_, skip) in enumerate(steps):
            slot = at[i]
            while table[slot] >= 0:
                slot = (slot + skip) % size
            table[slot], at[i], left = i, (slot + skip) % size, left - 1
            if not left:
                break
    return table


def slot_of(key: Column, size: int) -> Column:
    """48 bits of the key's digest modulo the size; portable to any SQL engine."""
    digits = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(_NULL_KEY))), 1, 12)
    return F.pmod(F.conv(digits, 16, 10).cast("bigint"), F.lit(size).cast("bigint")).cast("int")


def lookup_table(spark: SparkSession, shards: list[str], size: int = TABLE_SIZE) -> DataFrame:
    """(slot, shard), one row per slot, ready to broadcast."""
    table = fill(shards, size)
    names = F.array(*[F.lit(s) for s in shards])
    owners = F.split(F.lit(",".join(map(str, table))), ",")
    return (spark.range(1).select(F.posexplode(owners).alias("slot", "owner"))
            .select("slot", F.element_at(names, F.col("owner").cast("int") + 1).alias("shard")))


def place(rows: DataFrame, shards: list[str], key: str = "doc_id", keep: tuple = ("doc_id",),
          size: int = TABLE_SIZE) -> DataFrame:
    """Kept columns, ``slot`` and ``shard`` of every row."""
    names = kept(keep, ("slot", "shard"))
    placed = rows.select(*[col(k) for k in names], slot_of(col(key), size).alias("slot"))
    table = F.broadcast(lookup_table(rows.sparkSession, shards, size))
    return placed.join(table, "slot").select(*[col(k) for k in names], "slot", "shard")


def write_shards(rows: DataFrame, path: str, shards: list[str], key: str = "doc_id", size: int = TABLE_SIZE,
                 pieces: int = 8) -> None:
    """Write whole rows to one folder per shard. A shard is written by ``pieces`` tasks, so a large one is split."""
    marked = rows.withColumn("_slot", slot_of(col(key), size)).join(
        F.broadcast(lookup_table(rows.sparkSession, shards, size)), F.col("_slot") == F.col("slot")).drop("_slot", "slot")
    piece = F.pmod(F.xxhash64(*[c for c in marked.columns if c != "shard"]), F.lit(pieces))
    (marked.repartition(len(shards) * pieces, F.col("shard"), piece)
     .write.mode("errorifexists").partitionBy("shard").parquet(path))
