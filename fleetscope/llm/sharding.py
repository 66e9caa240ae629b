"""Stable placement of documents on shards through a permutation-filled lookup table."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

#: Slots of the table, a prime. The table is the only thing that is broadcast; its size is this parameter.
SLOTS = 65537


def _number(text: str, salt: str) -> int:
    return int.from_bytes(hashlib.sha256(f"{salt}:{text}".encode()).digest()[:8], "big")


def fill_table(shards: Sequence[str], slots: int = SLOTS) -> list[int]:
    """Slot -> index of its shard. Each shard prefers slots in its own order, start + i * step modulo the prime; shards take
    turns and claim their best free slot, so shares differ by one slot at most and a shard that leaves moves little else."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards need distinct names, at least one")
    if slots < len(shards) or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("slots must be a prime number, no smaller than the number of shards")
    at = [_number(s, "start") % slots for s in shards]
    step = [_number(s, "step") % (slots - 1) + 1 for s in shards]
    owner, free = [-1] * slots, slots
    while free:
        for i in range(min(len(shards), slots)):
            while owner[at[i]] >= 0:
                at[i] = (at[i] + step[i]) % slots
            owner[at[i]] = i
            free -= 1
            if not free:
                break
    return owner


def slot_of(keys: Sequence[Column], slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(slots)).cast("int")


def assign_shards(docs: DataFrame, shards: Sequence[str], key_cols: Sequence[str] = ("doc_id",), slots: int = SLOTS) -> DataFrame:
    """Add ``slot`` and ``shard`` to (key columns); one hash and one look-up in a broadcast table of ``slots`` rows, no shuffle.

    Equal keys share a shard; repeated rows each get theirs. A null key is a key like any other. Columns of ``docs``
    besides the keys are left out, so they cannot clash.
    """
    owner = fill_table(shards, slots)
    lookup = docs.sparkSession.createDataFrame([(i, shards[s]) for i, s in enumerate(owner)], "slot int, shard string")
    placed = docs.select(*key_cols, slot_of([F.col(k) for k in key_cols], slots).alias("slot"))
    return placed.join(F.broadcast(lookup), "slot").select(*key_cols, "slot", "shard")


def write_shards(docs: DataFrame, shards: Sequence[str], path: str, key_cols: Sequence[str] = ("doc_id",), slots: int = SLOTS) -> None:
    """Write ``docs`` as Parquet with one folder for each shard. Rebalancing splits a large shard over several tasks and files."""
    owner = fill_table(shards, slots)
    lookup = docs.sparkSession.createDataFrame([(i, shards[s]) for i, s in enumerate(owner)], "__slot int, __shard string")
    placed = docs.withColumn("__slot", slot_of([F.col(k) for k in key_cols], slots)).join(F.broadcast(lookup), "__slot").drop("__slot")
    placed.hint("rebalance", "__shard").withColumnRenamed("__shard", "shard_name").write.partitionBy("shard_name").parquet(path)
