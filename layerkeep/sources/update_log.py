"""Update logs: folders of Parquet messages (topic, partition, offset, key, payload) consumed like a broker's topics.

``LogConsumer`` keeps commits, seeks, polls and reports progress; the engine
needs no more than these from a consumer, so another source can take its
place. ``kafka_options`` makes the options of Spark's Kafka reader from the
same configuration; the connector is a separate jar.
"""

from __future__ import annotations

import json
import time
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..errors import FailedPrecondition, InvalidArgument
from ..functions.hashing import key_bits
from ..functions.positions import parse_key
from ..operators.updates import BATCH_SEQ
from .artifact import Progress
from .files import Files

MESSAGE = "topic string, partition int, offset long, key string, payload binary"


@dataclass(frozen=True)
class ConsumerConfig:
    bootstrap_servers: str
    group_id: str
    topics: tuple[str, ...]

    def __post_init__(self):
        if not self.bootstrap_servers or not self.group_id or not self.topics:
            raise InvalidArgument("servers, group and topics are needed")
        if any(not t for t in self.topics) or len(set(self.topics)) < len(self.topics):
            raise InvalidArgument("topics are empty or repeat")


def kafka_options(config: ConsumerConfig, starting: dict[str, dict[int, int]] | None = None) -> dict[str, str]:
    first = json.dumps({t: {str(p): o for p, o in parts.items()} for t, parts in starting.items()}) if starting else "earliest"
    return {"kafka.bootstrap.servers": config.bootstrap_servers, "kafka.group.id": config.group_id, "subscribe": ",".join(config.topics), "startingOffsets": first, "failOnDataLoss": "true"}


def from_kafka(rows: DataFrame) -> DataFrame:
    """Rows of Kafka's reader under the names of ``MESSAGE``."""
    return rows.select("topic", "partition", "offset", F.col("key").cast("string").alias("key"), F.col("value").alias("payload"))


def kafka_messages(spark: SparkSession, config: ConsumerConfig, starting: dict[str, dict[int, int]] | None = None) -> DataFrame:
    """The topics as a stream for ``upserts.ingest``, from the earliest or the given offsets; needs the Kafka connector's jar."""
    return from_kafka(spark.readStream.format("kafka").options(**kafka_options(config, starting)).load())


class Consumer(Protocol):
    def seek(self, positions: dict[tuple[str, int], int]) -> None: ...
    def poll(self, max_messages: int, timeout_ms: int = 0) -> DataFrame | None: ...
    def commit(self, positions: dict[tuple[str, int], int]) -> None: ...
    def progress(self) -> list[Progress]: ...


def check_poll(max_messages: int, timeout_ms: int = 0) -> None:
    if max_messages < 1:
        raise InvalidArgument("a poll needs at least one message")
    if timeout_ms < 0:
        raise InvalidArgument("a timeout is negative")


def parsed(messages: DataFrame) -> DataFrame:
    """Messages with their text keys as bit patterns (null where no unsigned 64-bit number)."""
    return messages.withColumn("pk", key_bits(parse_key(F.col("key")))).drop("key")


class LogConsumer:
    """A consumer group over a folder of messages. Commits lie in a small file beside it."""

    def __init__(self, spark: SparkSession, path: str, config: ConsumerConfig):
        self.spark, self.path, self.config, self.files = spark, path, config, Files(spark)
        self.commits = f"{path}.commits/{config.group_id}.json"
        self.next: dict[tuple[str, int], int] = self.committed()

    def messages(self) -> DataFrame:
        if not self.files.exists(self.path):
            return self.spark.createDataFrame([], MESSAGE)
        return self.spark.read.schema(MESSAGE).parquet(self.path).filter(F.col("topic").isin(list(self.config.topics)))

    def committed(self) -> dict[tuple[str, int], int]:
        if not self.files.exists(self.commits):
            return {}
        return {(t, p): o for t, p, o in json.loads(self.files.read_text(self.commits))}

    def seek(self, positions: dict[tuple[str, int], int]) -> None:
        seen = set()
        for (topic, partition), offset in positions.items():
            if topic not in self.config.topics or partition < 0 or offset < 0 or (topic, partition) in seen:
                raise InvalidArgument("a position to seek is not valid")
            seen.add((topic, partition))
        self.next = dict(positions)

    def poll(self, max_messages: int, timeout_ms: int = 0) -> DataFrame | None:
        """The next messages of all partitions, at most so many offsets of each; None if there are none within the timeout."""
        check_poll(max_messages, timeout_ms)
        until = time.monotonic() + timeout_ms / 1000
        while (batch := self._ready(max_messages)) is None and (left := until - time.monotonic()) > 0:
            time.sleep(min(0.05, left))
        return batch

    def _ready(self, max_messages: int) -> DataFrame | None:
        """The messages that are there.

        seq is the order within a partition, which is all that updates of one key
        need: how far a message is behind its partition's first one. Nothing is
        sorted, and messages stay where they were read; only where a partition has
        more than may be polled its offsets alone are ranked, to find the last.
        The positions move on; what was polled is consumed again unless committed.
        """
        start = F.lit(0).cast("long")
        for (t, p), o in self.next.items():
            start = F.when((F.col("topic") == t) & (F.col("partition") == p), F.lit(o).cast("long")).otherwise(start)
        rows = self.messages().filter(F.col("offset") >= start)
        n, end = F.count(F.lit(1)).alias("n"), (F.max("offset") + 1).alias("end")
        parts = rows.groupBy("topic", "partition").agg(n, F.min("offset").alias("first"), end).collect()  # one row for each partition
        if not parts:
            return None
        ends = {(r.topic, r.partition): min(r.end, r.first + BATCH_SEQ) for r in parts}
        if any(min(r.n, r.end - r.first) > max_messages for r in parts):
            rank = F.row_number().over(Window.partitionBy("topic", "partition").orderBy("offset"))
            some = rows.select("topic", "partition", "offset").withColumn("rank", rank).filter(F.col("rank") <= max_messages)
            for r in some.groupBy("topic", "partition").agg(end).collect():
                ends[r.topic, r.partition] = min(ends[r.topic, r.partition], r.end)
        self.next |= ends
        side = self.spark.createDataFrame([(r.topic, r.partition, r.first, ends[r.topic, r.partition]) for r in parts], "t string, p int, first long, end long")
        here = F.col("topic").eqNullSafe(F.col("t")) & F.col("partition").eqNullSafe(F.col("p"))
        taken = rows.join(F.broadcast(side), here).filter(F.col("offset") < F.col("end"))
        return parsed(taken.withColumn("seq", F.col("offset") - F.col("first")).drop("t", "p", "first", "end"))

    def commit(self, positions: dict[tuple[str, int], int]) -> None:
        now = self.committed() | positions
        self.files.write_text(self.commits, json.dumps([[t, p, o] for (t, p), o in sorted(now.items())]))

    def progress(self) -> list[Progress]:
        """Committed next offset and end offset of each partition; without a commit 0."""
        done = self.committed()
        ends = self.messages().groupBy("topic", "partition").agg((F.max("offset") + 1).alias("o")).collect()
        known = {(r.topic, r.partition): r.o for r in ends}
        for k, o in done.items():
            known.setdefault(k, o)
        return [Progress(t, p, done.get((t, p), 0), o) for (t, p), o in sorted(known.items())]


def merged_progress(target: list[Progress], observed: list[Progress]) -> list[Progress]:
    """Progress towards a target: high watermarks never fall. A partition that is not observed fails."""
    if not target:
        raise FailedPrecondition("the source progress is empty")
    now = {(p.topic, p.partition): p for p in observed}
    out = []
    for t in target:
        o = now.get((t.topic, t.partition))
        if o is None:
            raise FailedPrecondition(f"progress lacks partition {t.topic}/{t.partition}")
        out.append(Progress(t.topic, t.partition, o.next_offset, max(t.high_watermark, o.high_watermark)))
    return out


def behind(progress: list[Progress]) -> bool:
    return any(p.next_offset < p.high_watermark for p in progress)
