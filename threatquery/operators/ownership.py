"""Ownership of a registry over time: who may insert, and since when.

A transfer takes effect if its caller owns the registry at that time and the new
owner isn't the zero address. Whether it does depends on all transfers before
it, but a range of calls acts on the owner in a simple way: it maps each owner
that calls in it to the owner at its end, and leaves any other as it is. So
calls are cut into sorted ranges, each range works out its map, the owners at
the starts of the ranges follow from one lookup a range, and then all ranges
decide their calls at once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threatquery.operators import registry as reg
from threatquery.sources.sinks import materialise

ZERO_ADDRESS = "0x" + "0" * 40
INSERT, TRANSFER = "insert", "transfer"


def moved(calls: list[tuple[str | None, str | None]]) -> dict[str, str]:
    """The owner at the end for each owner at the start whom the transfers (caller, new owner) change."""
    starts: dict[str, list[str]] = {}  # by the present owner, those who would have come to it; an owner who hasn't moved comes to itself
    gone: set[str] = set()
    for caller, new in calls:
        if caller is None or new is None or new == ZERO_ADDRESS or caller == new:
            continue
        own = starts.pop(caller, []) + ([caller] if caller not in gone else [])
        gone.add(caller)
        held = starts.setdefault(new, [])
        if len(held) < len(own):
            starts[new], held, own = own, own, held
        held += own
    return {start: end for end, own in starts.items() for start in own if start != end}


def _ranges(calls: DataFrame, order: str) -> DataFrame:
    parts = int(calls.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = calls.select(F.col(f"`{order}`").alias("place"), "kind", "caller", "new_owner").repartitionByRange(parts, "place").sortWithinPartitions("place")
    return materialise(ranges.withColumn("part", F.spark_partition_id()), "calls")


def owners(calls: DataFrame, first_owner: str, order: str = "seq") -> DataFrame:
    """``order``, owner and reason of every call: the owner at its time, and why a call of the owner's only is refused, else null.

    ``calls``: a distinct ``order``, kind (insert or transfer), caller, new_owner
    (of a transfer). A null caller is never the owner, a null new owner counts as
    the zero address, and a caller who hands over to itself stays.
    """
    spark, held = calls.sparkSession, _ranges(calls, order)

    def maps(batches):
        part, own = None, []
        for batch in batches:
            for p, kind, caller, new in zip(*(batch.column(c).to_pylist() for c in ("part", "kind", "caller", "new_owner")), strict=True):
                if p != part and part is not None:
                    yield _map(part, moved(own))
                    own = []
                part = p
                if kind == TRANSFER:
                    own.append((caller, new))
        if part is not None:
            yield _map(part, moved(own))

    dealt = held.repartition("part").sortWithinPartitions("part", "place")
    moves = materialise(dealt.mapInArrow(maps, "part int, start string, end string"), "moves")
    starts, owner = {}, first_owner
    for part in sorted(r.part for r in held.select("part").distinct().collect()):  # a row for each range
        starts[part] = owner
        step = moves.where((F.col("part") == part) & (F.col("start") == owner)).first()
        owner = step.end if step else owner
    starts = spark.sparkContext.broadcast(starts)

    def decide(batches):
        part, owner = None, None
        for batch in batches:
            places, kinds, callers, news, parts = (batch.column(c).to_pylist() for c in ("place", "kind", "caller", "new_owner", "part"))
            at, reasons = [], []
            for kind, caller, new, p in zip(kinds, callers, news, parts, strict=True):
                if p != part:
                    part, owner = p, starts.value[p]
                at.append(owner)
                reason = "NotOwner" if caller != owner else "ZeroAddress" if kind == TRANSFER and new in (None, ZERO_ADDRESS) else None
                reasons.append(reason)
                if kind == TRANSFER and reason is None:
                    owner = new
            yield pa.RecordBatch.from_arrays([batch.column("place"), pa.array(at, pa.string()), pa.array(reasons, pa.string())], names=["place", "owner", "reason"])

    kind = held.schema["place"].dataType.simpleString()
    out = dealt.select("place", "kind", "caller", "new_owner", "part").mapInArrow(decide, f"place {kind}, owner string, reason string")
    return out.withColumnRenamed("place", order)


def _map(part: int, own: dict[str, str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(own), part), pa.int32()), pa.array(list(own), pa.string()), pa.array(list(own.values()), pa.string())], names=["part", "start", "end"])


def transfers(decided: DataFrame, calls: DataFrame, order: str = "seq") -> DataFrame:
    """The log of ownership: one OwnershipTransferred for each transfer that took effect."""
    made = calls.where(F.col("kind") == TRANSFER).join(decided.where("reason is null"), order)
    return made.select(F.lit("OwnershipTransferred").alias("event"), order, F.col("owner").alias("previous_owner"), "new_owner")


def guarded_insert(registry: DataFrame, batch: DataFrame, calls: DataFrame, first_owner: str, order: str = "seq") -> DataFrame:
    """``batch`` as of ``registry.guarded_insert``, where the owner is that of each row's own time.

    ``calls``: the transfers, numbered by ``order`` among the rows of the batch.
    """
    kinds = [F.lit(INSERT).alias("kind"), F.col("submitter").alias("caller"), F.lit(None).cast("string").alias("new_owner")]
    both = batch.select(order, *kinds).unionByName(calls.where(F.col("kind") == TRANSFER).select(order, "kind", "caller", "new_owner"))
    at = owners(both, first_owner, order).select(order, F.col("owner").alias("_owner"))
    return reg.guarded_insert(registry, batch.join(at, order), F.col("row._owner"), order).drop("_owner")
