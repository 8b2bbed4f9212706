"""Sharding by a permutation-filled lookup table.

Every shard has its own order of preference over the slots of a table of prime size: start at an
offset and go on by a stride, both from hashes of its name. Shards take turns; on its turn a shard
claims the first slot of its order that is free, until the table is full. All shards so get nearly
equally many slots, and a shard that comes or goes moves few of the others'. A row's key is hashed
to a slot, and the shard of the slot is looked up in the broadcast table, whose size is the prime.
"""
from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import kept_names

#: A prime that is over a hundred times the usual number of shards.
SLOTS = 65_537
SHARDS = tuple(f"shard-{i:03d}" for i in range(64))
MAX_SLOTS = 1_000_003


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def lookup(shards=SHARDS, slots: int = SLOTS) -> list[int]:
    """Shard number of each slot."""
    if not is_prime(slots) or not len(set(shards)) == len(shards) or not 0 < len(shards) <= slots or slots > MAX_SLOTS:
        raise ValueError(f"a prime number of slots up to {MAX_SLOTS} and as many different shards at most")
    at, stride = [], []
    for name in shards:
        d = hashlib.md5(name.encode()).digest()
        at.append(int.from_bytes(d[:8], "big") % slots)
        stride.append(int.from_bytes(d[8:], "big") % (slots - 1) + 1 if slots > 2 else 1)
    table, left = [-1] * slots, slots
    while left:
        for i in range(len(shards)):
            while table[at[i]] >= 0:
                at[i] = (at[i] + stride[i]) % slots
            table[at[i]] = i
            left -= 1
            if not left:
                break
    return table


def slot_of(*keys: Column, slots: int = SLOTS) -> Column:
    """First 15 hex digits of the MD5 of the keys (joined by unit separators; null as one record separator), modulo the slots."""
    text = F.concat_ws("\x1f", *(F.coalesce(k.cast("string"), F.lit("\x1e")) for k in keys))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("bigint") % slots


def table_of(spark: SparkSession, shards=SHARDS, slots: int = SLOTS) -> DataFrame:
    """(slot, shard) as a frame; it has exactly `slots` rows."""
    numbers = ",".join(map(str, lookup(shards, slots)))
    names = F.array(*map(F.lit, shards))
    return spark.range(1).select(F.posexplode(F.split(F.lit(numbers), ",")).alias("slot", "s")).select("slot", names[F.col("s").cast("int")].alias("shard"))


def assign(df: DataFrame, key_cols: list[str], shards=SHARDS, slots: int = SLOTS, keep: list[str] | None = None) -> DataFrame:
    """The kept columns of df (all, if None) with slot and shard.

    Equal keys go to one shard, wherever they are, so repeated rows do; use a key that is unique, or
    nearly, if shards are to be of equal size. Nulls in a key are values of their own; texts in a key
    count whole, however long. No shuffle: each row asks the broadcast table. A kept column called
    slot or shard gets an underscore at its end. An empty table gives an empty result.
    """
    lead = df.columns if keep is None else list(keep)
    inner = [f"c{i}" for i in range(len(lead))]
    rows = df.select(*(F.col(c).alias(n) for c, n in zip(lead, inner)), slot_of(*map(F.col, key_cols), slots=slots).cast("int").alias("slot"))
    met = rows.join(F.broadcast(table_of(df.sparkSession, shards, slots)), "slot").select(*inner, "slot", "shard")
    return met.toDF(*kept_names(lead, ("slot", "shard")), "slot", "shard")


def oracle_sql(shards=SHARDS, slots: int = SLOTS) -> str:
    numbers = ",".join(map(str, lookup(shards, slots)))
    names = "[" + ",".join(f"'{s}'" for s in shards) + "]"
    return f"""
with t as (select string_split('{numbers}', ',') as slots),
d as (select doc_id, cast(('0x' || substr(md5(coalesce(cast(doc_id as varchar), chr(30))), 1, 15)) as bigint) % {slots} as slot from documents)
select doc_id, cast(slot as integer) as slot, {names}[cast(t.slots[slot + 1] as integer) + 1] as shard from d, t"""
