"""Consistent placement by a permutation-filled lookup table, in DataFrame operations only.

Every shard has a permutation of the slots of a prime-sized table; the shards
take turns, each claiming the first free slot of its own order, until the table
is full.  Shards then hold equal numbers of slots within one, and adding or
removing a shard moves few slots.  A row goes to the shard of its key's slot.
The table has `slots` rows, a parameter and not a property of the data, so it
is broadcast; placement is one lookup a row, without a shuffle.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Hexadecimal digits of a key's MD5 that make its hash.
_DIGITS = 15


def _hash(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:_DIGITS], 16)


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def lookup_table(shards: list[str], slots: int) -> list[int]:
    """The number of the shard that owns each slot.

    slots: a prime, at least the number of shards; a hundred times as many keep
    the shares within a hundredth of each other.  Names must differ.
    """
    if not is_prime(slots) or slots < len(shards) or not shards or len(set(shards)) < len(shards):
        raise ValueError("a prime number of slots, no fewer than the shards, and shards of different names are needed")
    at = [_hash(f"{s}#offset") % slots for s in shards]
    skip = [_hash(f"{s}#skip") % (slots - 1) + 1 if slots > 1 else 1 for s in shards]
    owner = [-1] * slots
    for turn in range(slots):
        k = turn % len(shards)
        while owner[at[k]] >= 0:
            at[k] = (at[k] + skip[k]) % slots
        owner[at[k]] = k
    return owner


def slot_of(key: Column, slots: int) -> Column:
    """The slot of a key; a null key has that of the empty text."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text), 1, _DIGITS), 16, 10).cast("long") % F.lit(slots)


def table_of(spark: SparkSession, shards: list[str], slots: int) -> DataFrame:
    """The lookup table as rows (slot, shard)."""
    owners = ",".join(map(str, lookup_table(shards, slots)))
    return spark.range(1).select(F.posexplode(F.split(F.lit(owners), ",")).alias("slot", "shard")).select(F.col("slot").cast("long"), F.col("shard").cast("int"))


def place(df: DataFrame, key: str, shards: list[str], slots: int = 65537, slot: str = "slot", shard: str = "shard") -> DataFrame:
    """The rows of df with the slot and the shard of their key; columns of these names are replaced.

    Every row stays, repeated ones too; equal keys, and all null keys, share a
    shard.  An empty table stays empty.
    """
    rows = df.select(*(c for c in df.columns if c not in (slot, shard)), slot_of(F.col(key), slots).alias(slot))
    table = table_of(df.sparkSession, shards, slots).select(F.col("slot").alias("__slot"), F.col("shard").alias(shard))
    return rows.join(F.broadcast(table), rows[slot] == table["__slot"], "left").drop("__slot")


def oracle(table: str, key: str, shards: int, slots: int) -> str:
    """DuckDB's SQL for place(): the table is filled by recursion, a claim a step."""
    return f"""
    WITH RECURSIVE names AS (
      SELECT i::BIGINT AS i,
             ('0x' || substr(md5('shard-' || lpad(i::VARCHAR, 5, '0') || '#offset'), 1, {_DIGITS}))::BIGINT % {slots} AS o,
             ('0x' || substr(md5('shard-' || lpad(i::VARCHAR, 5, '0') || '#skip'), 1, {_DIGITS}))::BIGINT % {slots - 1} + 1 AS s
      FROM range({shards}) r(i)),
    lists AS (SELECT list(o ORDER BY i) AS os, list(s ORDER BY i) AS ss FROM names),
    fill AS (
      SELECT 0::BIGINT AS turn, list_transform(range({slots}), lambda x: -1::BIGINT) AS owner,
             list_transform(range({shards}), lambda x: 0::BIGINT) AS tried
      UNION ALL
      SELECT turn + 1,
             list_concat(list_append(owner[1 : p], k), owner[p + 2 :]),
             list_concat(list_append(tried[1 : k], j + 1), tried[k + 2 :])
      FROM (SELECT turn, owner, tried, k, j, (os[k + 1] + j * ss[k + 1]) % {slots} AS p
            FROM (SELECT turn, owner, tried, os, ss, turn % {shards} AS k,
                         list_filter(range(tried[turn % {shards} + 1], {slots}),
                           lambda j: owner[(os[turn % {shards} + 1] + j * ss[turn % {shards} + 1]) % {slots} + 1] < 0)[1] AS j
                  FROM fill, lists WHERE turn < {slots}))),
    owned AS (SELECT unnest(owner) AS shard, generate_subscripts(owner, 1) - 1 AS slot FROM fill WHERE turn = {slots}),
    keyed AS (SELECT {key}, ('0x' || substr(md5(coalesce({key}::VARCHAR, '')), 1, {_DIGITS}))::BIGINT % {slots} AS slot FROM {table})
    SELECT {key}, k.slot, o.shard::INTEGER AS shard FROM keyed k JOIN owned o ON k.slot = o.slot
    """
