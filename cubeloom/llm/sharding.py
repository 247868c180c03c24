"""Placement by a permutation-filled lookup table.

Every shard has a permutation of the slots of a table whose size is a prime: offset + i * skip. The
shards take turns; at its turn a shard claims the first slot of its permutation that is still free
(a shard of weight w claims w in a turn). The table holds TABLE slots whatever the data's size, so it
is broadcast, and a key's shard is found by one hash and one lookup. A shard that leaves or joins
moves few keys besides its own.

Defined results: a null key hashes like the empty one. Repeated keys share a shard. Columns slot and
shard of the input are replaced, and either may be the key; other columns pass through.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A prime; its share of a broadcast is 12 bytes a slot.
TABLE = 65_537


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def preference(name: str, size: int) -> tuple[int, int]:
    """Offset and skip of a shard's permutation; any skip from 1 to size - 1 visits every slot of a prime table."""
    h = hashlib.sha256(name.encode()).digest()
    return int.from_bytes(h[:8], "big") % size, int.from_bytes(h[8:16], "big") % (size - 1) + 1


def lookup_table(shards: dict[str, int], size: int = TABLE) -> list[str]:
    """The shard of each slot. shards: the weight of each."""
    if not is_prime(size) or not shards or len(shards) > size or min(shards.values()) < 1:
        raise ValueError("the table's size must be a prime not below the number of shards, and weights 1 or more")
    order = {s: (o + k * np.arange(size, dtype=np.int64)) % size for s in sorted(shards) for o, k in [preference(s, size)]}
    at, table, left = dict.fromkeys(order, 0), [""] * size, size
    while left:
        for s, slots in order.items():
            for _ in range(shards[s]):
                while at[s] < size and table[slots[at[s]]]:
                    at[s] += 1
                if left:
                    table[slots[at[s]]] = s
                    left -= 1
    return table


def slot_of(key: Column, size: int = TABLE) -> Column:
    """32 bits of the key's MD5, modulo the table's size."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long"), F.lit(size)).cast("int")


def place(df: DataFrame, key: str, shards: dict[str, int], size: int = TABLE) -> DataFrame:
    """df with slot and shard."""
    table = df.sparkSession.createDataFrame(list(enumerate(lookup_table(shards, size))), "slot int, shard string")
    others = [df[c] for c in df.columns if c not in ("slot", "shard")]
    return df.select(*others, slot_of(df[key], size).alias("slot")).join(F.broadcast(table), "slot")
