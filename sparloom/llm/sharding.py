"""Sharding through a permutation-filled lookup table (operator 2).

Every shard has its own permutation of the slots of a prime-sized table, given by an offset and a step drawn
from a hash of its name.  Shards take turns: each claims the first slot of its permutation that is still
free, until the table is full.  A shard with weight w takes w turns a round.  Placement is one hash and one
look-up in the broadcast table, whose size is a bounded parameter and doesn't grow with the data.
"""

from __future__ import annotations

import hashlib
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Entries that a lookup table may have; it is broadcast (12 bytes an entry).
MAX_SLOTS = 5_000_011


def _digest(name: str, salt: str) -> int:
    return int(hashlib.md5(f"{salt}:{name}".encode()).hexdigest()[:15], 16)


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def lookup_table(shards: Sequence[str], slots: int = 65_537, weights: Mapping[str, int] | None = None) -> list[str]:
    """The shard of every slot.

    Shard names must be distinct and not empty; the number of slots must be prime, at least the number of
    shards and at most ``MAX_SLOTS``.  Shares differ by about one slot per shard; a shard that leaves gives
    up its own slots and few others move.
    """
    names = list(shards)
    if not names or len(set(names)) != len(names):
        raise ValueError("shard names must be distinct and at least one")
    if not _is_prime(slots) or slots > MAX_SLOTS or slots < len(names):
        raise ValueError(f"slots must be a prime from {len(names)} to {MAX_SLOTS}")
    turns = [int((weights or {}).get(s, 1)) for s in names]
    if min(turns) < 1:
        raise ValueError("weights must be positive whole numbers")
    at = [_digest(s, "offset") % slots for s in names]
    step = [_digest(s, "step") % (slots - 1) + 1 if slots > 2 else 1 for s in names]
    owner: list[str | None] = [None] * slots
    free = slots
    while free:
        for i, name in enumerate(names):
            for _ in range(turns[i]):
                while owner[at[i]] is not None:
                    at[i] = (at[i] + step[i]) % slots
                owner[at[i]] = name
                free -= 1
                if not free:
                    return owner  # type: ignore[return-value]
    return owner  # type: ignore[return-value]


def slot_of(key: Column, slots: int) -> Column:
    """md5 based, so that any engine can place a key; a null key has the slot of the empty string."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.pmod(F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long"), F.lit(slots))


def assign_shards(df: DataFrame, key_col: str, shards: Sequence[str], slots: int = 65_537, weights: Mapping[str, int] | None = None) -> DataFrame:
    """The rows of ``df`` with the columns ``slot`` and ``shard`` (which replace columns of these names).

    Every row stays, repeated rows and null keys included; equal keys go to equal shards, so a hot key stays
    on one shard by design, while hot groups (a source) spread over all of them when rows are keyed by id.
    """
    spark = df.sparkSession
    owners = lookup_table(shards, slots, weights)
    places = spark.createDataFrame([(i, s) for i, s in enumerate(owners)], "slot long, shard string")
    keyed = df.drop("slot", "shard").withColumn("slot", slot_of(F.col(key_col), slots))
    return keyed.join(F.broadcast(places), "slot", "left").select(*[c for c in df.columns if c not in ("slot", "shard")], "slot", "shard")
