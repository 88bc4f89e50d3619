"""Sharding by a permutation-filled lookup table (operator 10).

Every shard has its own permutation of the slots of a table whose size is a prime: it starts
at an offset and steps by a skip, both drawn from a hash of the shard's name. Shards take turns
claiming their next free slot until the table is full, so shares differ by at most one turn
(by weight, if weights are given) and a change of the shard list moves few slots. A row's key
is hashed to a slot and the slot gives the shard: one array lookup, no shuffle.

The table has ``table_size`` entries whatever the data, so what is sent to the workers is bounded by
that parameter (``MAX_TABLE``); larger tables are refused.

Edge cases: a null key goes to the slot of the empty string's hash under its own tag, so all null keys
share one shard; an empty table gives no rows; extra columns are kept; a shard list with
repeated names is refused; columns of the input that are named like the output give way to it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Largest allowed table: 4 bytes a slot, so 8 MB at most are broadcast.
MAX_TABLE = 2_000_003
#: A prime well over 100 times the default shard count keeps shares within one percent.
DEFAULT_TABLE = 65_537


def is_prime(n: int) -> bool:
    """Trial division; tables are small enough."""
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def _draw(name: str, tag: str, below: int) -> int:
    return int(hashlib.md5(f"{tag}|{name}".encode()).hexdigest()[:15], 16) % below


def lookup_table(shards: Sequence[str], table_size: int = DEFAULT_TABLE, weights: Sequence[int] | None = None) -> np.ndarray:
    """Slot -> index into ``shards``. A shard of weight w takes w slots on its turn."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be distinct names, one at least")
    if not is_prime(table_size) or not len(shards) <= table_size <= MAX_TABLE:
        raise ValueError(f"table_size must be a prime from the number of shards to {MAX_TABLE}")
    weights = list(weights or [1] * len(shards))
    if len(weights) != len(shards) or min(weights) < 1:
        raise ValueError("one weight of at least 1 for each shard")
    at = [_draw(s, "offset", table_size) for s in shards]
    skip = [_draw(s, "skip", table_size - 1) + 1 for s in shards]
    table = np.full(table_size, -1, dtype=np.int32)
    left = table_size
    while left:
        for k, turns in enumerate(weights):
            for _ in range(min(turns, left)):
                while table[at[k]] >= 0:
                    at[k] = (at[k] + skip[k]) % table_size
                table[at[k]] = k
                left -= 1
    return table


def slot_of(key: Column, table_size: int) -> Column:
    """Slot of a key: the first 60 bits of an MD5 of its text, modulo the table size."""
    tagged = F.coalesce(F.concat(F.lit("k"), key.cast("string")), F.lit("null"))
    return F.pmod(F.conv(F.substring(F.md5(tagged.cast("binary")), 1, 15), 16, 10).cast("long"), F.lit(table_size)).cast("int")


def assign_shards(df: DataFrame, key: str, shards: Sequence[str], table_size: int = DEFAULT_TABLE, weights: Sequence[int] | None = None) -> DataFrame:
    """``df`` with ``slot`` and ``shard``. The table travels as a broadcast join of fixed size."""
    table = lookup_table(shards, table_size, weights)
    spark = df.sparkSession
    lookup = spark.createDataFrame([([shards[k] for k in table.tolist()],)], "shards array<string>").select(F.posexplode("shards").alias("slot", "shard"))
    kept = [c for c in df.columns if c.lower() not in ("slot", "shard")]
    placed = df.select(*kept, slot_of(F.col(key), table_size).alias("slot"))
    return placed.join(F.broadcast(lookup), "slot").select(*kept, "slot", "shard")


def write_shards(placed: DataFrame, path: str) -> None:
    """One folder per shard; rows are not moved between tasks, so a hot shard is no single task's work."""
    placed.write.partitionBy("shard").parquet(path)
