"""Shard placement by a permutation-filled lookup table.

Every shard has a preference order over the slots of a table of prime size
(start and stride from a hash of its name). The shards take turns claiming
their next free slot until the table is full. A row's key hashes to a slot;
the table is broadcast (its size is the parameter ``slots``, whatever the data)
and gives the shard in constant time. Adding or removing a shard moves few
slots between the others.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import quoted, ship_package

#: Prime number of slots; at least 100 per shard keep the shards within about 1 %.
SLOTS = 65_537
#: A broadcast table has at most this many slots.
MOST_SLOTS = 1_000_003


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, math.isqrt(n) + 1))


def lookup_table(shards: Sequence[str], slots: int = SLOTS, weights: Sequence[int] | None = None) -> np.ndarray:
    """Index of the shard that owns each slot. A shard of weight w claims w
    slots in each turn (default 1)."""
    if len(set(shards)) != len(shards) or not shards:
        raise ValueError("shard names must be given and distinct")
    if not _is_prime(slots) or not len(shards) <= slots <= MOST_SLOTS:
        raise ValueError(f"slots must be prime, at least one per shard and at most {MOST_SLOTS}")
    weights = [1] * len(shards) if weights is None else list(weights)
    if len(weights) != len(shards) or min(weights) < 1:
        raise ValueError("one positive weight per shard is needed")
    at = [xxhash.xxh3_64_intdigest(s, seed=1) % slots for s in shards]
    stride = [xxhash.xxh3_64_intdigest(s, seed=2) % (slots - 1) + 1 for s in shards]
    owner = np.full(slots, -1, np.int32)
    free = slots
    while True:
        for k, turns in enumerate(weights):
            for _ in range(turns):
                while owner[at[k]] >= 0:
                    at[k] = (at[k] + stride[k]) % slots
                owner[at[k]] = k
                free -= 1
                if not free:
                    return owner


def place(df: DataFrame, keys: Sequence[str], shards: Sequence[str], slots: int = SLOTS,
          weights: Sequence[int] | None = None, spread: Sequence[str] = ()) -> DataFrame:
    """``df``'s key columns with ``slot`` and ``shard``.

    Rows of equal keys go to one shard. ``spread`` names columns hashed in
    place of the keys for rows whose keys are all NULL, so that a large NULL
    group does not fall into one shard. Repeated rows keep one row each, no
    rows give none; texts of any length are hashed whole. A key column named
    ``slot`` or ``shard`` comes back as ``key_slot`` or ``key_shard``; other
    columns are dropped, whatever their name.
    """
    spark = df.sparkSession
    ship_package(spark)
    owner = lookup_table(shards, slots, weights)
    own = spark.createDataFrame([(i, shards[k]) for i, k in enumerate(owner.tolist())], "slot int, shard string")
    cols = [F.col(quoted(k)) for k in keys]
    hashed = F.xxhash64(*cols)
    if spread:
        hashed = F.when(F.coalesce(*[c.cast("string") for c in cols]).isNull(), F.xxhash64(*[F.col(quoted(c)) for c in spread])).otherwise(hashed)
    placed = df.select(F.struct(*cols).alias("key"), F.pmod(hashed, F.lit(slots)).cast("int").alias("slot")).join(F.broadcast(own), "slot")
    named = [F.col(f"key.{quoted(k)}").alias(f"key_{k}" if k.lower() in ("slot", "shard") else k) for k in keys]
    return placed.select(*named, "slot", "shard")


def shard_sizes(placed: DataFrame) -> DataFrame:
    """Rows and slots in use by shard."""
    return placed.groupBy("shard").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("slot").alias("n_slots"))
