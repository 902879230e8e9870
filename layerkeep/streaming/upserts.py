"""Structured Streaming ingest: micro-batches applied to an index, and keyed state in the stream itself."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..errors import InvalidArgument
from ..functions.positions import IDEMPOTENT, NEWER, STALE
from ..plans.index import Changed
from ..sources.update_log import MESSAGE, parsed


def messages(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """A folder of Parquet messages as a stream; what Kafka's reader yields has the same columns after renaming."""
    reader = spark.readStream.schema(MESSAGE)
    if files_per_batch is not None:
        if files_per_batch < 1:
            raise InvalidArgument("a batch needs at least one file")
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def ordered(rows: DataFrame) -> DataFrame | None:
    """Parsed messages with their order of arrival within the batch: how far they are behind their partition's first offset. None if there are none.

    Nothing is sorted, so a partition's messages stay where they were read.
    """
    firsts = rows.groupBy("topic", "partition").agg(F.min("offset").alias("first")).collect()  # one row for each partition
    if not firsts:
        return None
    side = rows.sparkSession.createDataFrame([(r.topic, r.partition, r.first) for r in firsts], "t string, p int, first long")
    both = rows.join(F.broadcast(side), F.col("topic").eqNullSafe(F.col("t")) & F.col("partition").eqNullSafe(F.col("p")))
    return both.withColumn("seq", F.coalesce(F.col("offset") - F.col("first"), F.lit(0))).drop("t", "p", "first")


def ingest(stream: DataFrame, targets: list, checkpoint: str, available_now: bool = True, on_applied: Callable | None = None) -> StreamingQuery:
    """Applies every micro-batch to all targets (indexes), or to none.

    Each target decodes, checks and writes the batch first; only when all have
    done so is it published to any. A batch that is run again after a failure
    changes nothing, since equal offsets are idempotent. Offsets are committed
    by Spark's checkpoint after the batch.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        held = parsed(batch).persist()
        try:
            rows = ordered(held)
            if rows is None:
                return
            ready = []
            for t in targets:
                shards = t.directory()
                ready.append((t, shards, t.prepared(rows, shards[0].realtime.schema, shards)))
            for t, shards, batch in ready:
                try:
                    t.publish(*t.with_folder(shards, batch, shards[0].realtime.schema), base=shards)
                except Changed:  # something else was published to this target: checked and applied anew
                    t.apply(rows)
            if on_applied:
                on_applied(batch_id)
        finally:
            held.unpersist()

    writer = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


class NewestRow(StatefulProcessor):
    """Keyed state: partition and offset of a key's newest update. Emits each update with its decision."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.position = handle.getValueState("position", "partition int, offset long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values("seq", kind="stable")
        held = self.position.get() if self.position.exists() else None
        out = []
        for r in batch.itertuples():
            if held is not None and held[0] != r.partition:
                decision = "conflict"
            elif held is not None and r.offset <= held[1]:
                decision = STALE if r.offset < held[1] else IDEMPOTENT
            else:
                decision, held = NEWER, (int(r.partition), int(r.offset))
            out.append((key[0], r.partition, r.offset, decision))
        if held is not None:
            self.position.update((int(held[0]), int(held[1])))
        yield pd.DataFrame(out, columns=["pk", "partition", "offset", "decision"])

    def close(self) -> None:
        pass


def decisions(stream: DataFrame) -> DataFrame:
    """pk, partition, offset, decision of a stream of (pk, partition, offset, seq), with state that lasts across batches.

    Needs the RocksDB state store: ``spark.sql.streaming.stateStore.providerClass``.
    """
    rows = stream.select("pk", "partition", "offset", "seq")
    return rows.groupBy("pk").transformWithStateInPandas(NewestRow(), "pk long, partition int, offset long, decision string", "Append", "None")
