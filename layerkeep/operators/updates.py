"""Ordered updates: latest row for each key, checkpoints, lag, and applying a batch.

An update log is a DataFrame (topic, partition, offset, seq, pk, row): seq is the
order of arrival. Within a partition higher offsets are newer, an equal offset
is the first one again, a lower one stale; one key from several partitions
cannot be ordered and fails.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..errors import FailedPrecondition, InvalidArgument
from ..functions.positions import IDEMPOTENT, MAX_OFFSET, NEWER, STALE
from ..schema import Schema

#: Messages of a batch have a seq below this.
BATCH_SEQ = 1 << 44


def latest(log: DataFrame, boundary: int | None = None) -> DataFrame:
    """pk, row, partition, offset of each key's newest update that arrived before ``boundary`` (a seq).

    Partial aggregation reduces a hot key before the shuffle. Of equal offsets
    the first to arrive counts.
    """
    rows = log if boundary is None else log.filter(F.col("seq") < boundary)
    best = F.max_by(F.struct("row", "partition", "offset"), F.struct("offset", -F.col("seq"))).alias("b")
    return rows.groupBy("pk").agg(best).select("pk", "b.row", "b.partition", "b.offset")


def conflicts(log: DataFrame) -> DataFrame:
    """The keys that come from more than one partition."""
    spread = log.groupBy("pk").agg(F.min("partition").alias("low"), F.max("partition").alias("high"))
    return spread.filter("low <> high")


def classified(log: DataFrame) -> DataFrame:
    """``log`` with ``decision``: each update against the newest offset of its key that arrived before it."""
    before = Window.partitionBy("pk").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    current = F.max("offset").over(before)
    decision = F.when(F.col("offset") < current, STALE).when(F.col("offset") == current, IDEMPOTENT).otherwise(NEWER)
    return log.withColumn("decision", decision)


def checkpoint(log: DataFrame) -> DataFrame:
    """topic, partition, next_offset: one past the last message of each partition."""
    return log.groupBy("topic", "partition").agg((F.max("offset") + 1).alias("next_offset"))


def lag(committed: DataFrame, ends: DataFrame) -> DataFrame:
    """topic, partition, committed, high_watermark, lag; a partition without a commit starts at 0."""
    rows = ends.join(committed, ["topic", "partition"], "left")
    done = F.coalesce("next_offset", F.lit(0).cast("long"))
    behind = F.greatest(F.lit(0).cast("long"), F.col("high_watermark") - done)
    return rows.select("topic", "partition", done.alias("committed"), "high_watermark", behind.alias("lag"))


def catch_up_required(progress: DataFrame) -> DataFrame:
    """One row: whether any partition is behind."""
    return progress.agg(F.coalesce(F.bool_or(F.col("committed") < F.col("high_watermark")), F.lit(False)).alias("required"))


def validate(batch: DataFrame) -> None:
    """Raises for a batch that may not be applied, also for the first of its messages' ``error``s where it has such a column; runs one aggregation."""
    first_error = F.min_by("error", F.when(F.col("error").isNotNull(), F.col("seq"))) if "error" in batch.columns else F.lit(None)
    seen = batch.agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("topic").alias("topics"), F.min("partition").alias("p"), F.min("offset").alias("low"), F.max("offset").alias("high"),
        F.bool_or(F.col("pk").isNull()).alias("no_key"),
        F.min("seq").alias("first"), F.max("seq").alias("last"), first_error.alias("error"),
    ).first()
    if not seen.n:
        return
    if seen.topics != 1:
        raise InvalidArgument("a batch holds several topics")
    if seen.p is None or seen.p < 0 or seen.low is None or seen.low < 0:
        raise InvalidArgument("a source position is negative")
    if seen.high == MAX_OFFSET:
        raise InvalidArgument("an offset has no successor")
    if seen["first"] is None or seen["first"] < 0 or seen.last >= BATCH_SEQ:
        raise InvalidArgument("a message's seq is out of range")
    if seen.no_key:
        raise InvalidArgument("a key is no unsigned 64-bit number")
    if seen.error is not None:
        code, _, message = seen.error.partition(": ")
        raise (InvalidArgument if code == "invalid_argument" else FailedPrecondition)(message)


@dataclass(frozen=True)
class DeltaStats:
    """What a realtime layer holds. ``published_rows`` counts every attempt."""

    capacity: int = 0
    unique_keys: int = 0
    published_rows: int = 0
    slot_bytes: int = 0
    payload_bytes: int = 0

    @property
    def load_factor(self) -> float:
        return self.unique_keys / self.capacity if self.capacity else 0.0

    def unique_key_ratio(self, full_rows: int) -> float:
        return self.unique_keys / full_rows if full_rows else 0.0


def delta_stats(log: DataFrame, schema: Schema, capacity: int) -> DataFrame:
    """One row of statistics of a log, in one aggregation."""
    from ..functions.fields import payload_bytes

    n, keys = F.count(F.lit(1)), F.count_distinct("pk")
    return log.agg(
        F.lit(capacity).cast("long").alias("capacity"), keys.alias("unique_keys"), n.alias("published_rows"), (n * schema.layout().slot_bytes).alias("slot_bytes"),
        F.coalesce(F.sum(payload_bytes(schema)), F.lit(0).cast("long")).alias("payload_bytes"),
    )


def within_capacity(log: DataFrame, capacity: int) -> DataFrame:
    """``log`` with ``fits``: whether the update's key was among the first ``capacity`` keys of its shard to arrive.

    An existing key may always be updated; a new one past capacity may not.
    Each task ranks its own keys first and sends at most ``capacity`` of a shard.
    """
    first = log.groupBy("shard_id", "pk").agg(F.min("seq").alias("first_seq"))
    rank = F.row_number().over(Window.partitionBy("shard_id").orderBy("first_seq"))
    admitted = first.withColumn("place", rank).filter(F.col("place") <= capacity).select("pk", F.lit(True).alias("fits"))
    return log.join(admitted, "pk", "left").withColumn("fits", F.coalesce("fits", F.lit(False)))


def check_capacity(log: DataFrame, capacity: int) -> None:
    full = log.groupBy("shard_id").agg(F.count_distinct("pk").alias("keys")).filter(F.col("keys") > capacity).first()
    if full:
        raise FailedPrecondition(f"shard {full.shard_id} holds {full['keys']} keys, its capacity is {capacity}")
