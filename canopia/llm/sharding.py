"""Consistent placement through a permutation-filled lookup table."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARDS, SLOTS = 64, 65_537


def lookup_table(shards: list[str], slots: int = SLOTS) -> list[int]:
    """The shard number of each slot: shards take turns claiming the next free slot of their preference order.

    ``slots`` is a prime, so that offset and skip make every order a permutation. Each shard gets slots // n or one more.
    """
    if slots < 2 or any(slots % p == 0 for p in range(2, int(slots**0.5) + 1)):
        raise ValueError("slots must be a prime")
    if not 0 < len(shards) <= slots or len(set(shards)) < len(shards):
        raise ValueError("shards must be different, at least one and at most as many as slots")
    table = np.full(slots, -1, np.int32)
    place, skip = [], []
    for name in shards:
        h = hashlib.sha256(name.encode()).digest()
        place.append(int.from_bytes(h[:8]) % slots)
        skip.append(int.from_bytes(h[8:16]) % (slots - 1) + 1)
    filled = 0
    while filled < slots:
        for k in range(len(shards)):
            while table[place[k]] >= 0:
                place[k] = (place[k] + skip[k]) % slots
            table[place[k]] = k
            filled += 1
            if filled == slots:
                break
    return table.tolist()


def assign_shards(docs: DataFrame, keys: list[str], shards: int | list[str] = SHARDS, slots: int = SLOTS, salt: list[str] | None = None) -> DataFrame:
    """``docs`` with ``slot`` and ``shard``: a hash of ``keys`` picks a slot, a broadcast table of ``slots`` rows names the shard.

    A map-side join without any shuffle. Null keys are a value like any other; equal keys land together, so repeated rows
    do; ``salt`` names further columns that spread the rows of one hot key over many slots. Columns of ``docs`` named
    ``slot`` or ``shard`` are replaced. An empty table gives an empty one.
    """
    names = [f"shard-{i}" for i in range(shards)] if isinstance(shards, int) else shards
    table = docs.sparkSession.createDataFrame([*enumerate(lookup_table(names, slots))], "slot int, shard int")
    slot = F.pmod(F.xxhash64(*[F.coalesce(F.col(k).cast("string"), F.lit("\0null")) for k in [*keys, *(salt or [])]]), F.lit(slots)).cast("int")
    rest = [c for c in docs.columns if c not in ("slot", "shard")]
    return docs.withColumn("slot", slot).select(*rest, "slot").join(F.broadcast(table), "slot").select(*rest, "slot", "shard")
