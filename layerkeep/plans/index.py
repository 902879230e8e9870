"""The layered index: shards that are published atomically, reads over all layers, loads in the background.

Each shard has a generation with up to three layers: a full snapshot, a compact
delta and a realtime log. Layers are folders that never change once published;
a read fixes the folders it will use when it is planned, so a result outlives
any later publication. The whole directory of shards is one value. A publication
names the shards that it was made from and is refused if they have changed;
then it is made again from those that serve now. The directory is saved by
renaming, under the same lock, and an index can be opened again from it.
"""

from __future__ import annotations

import itertools
import json
import threading
import time
import uuid
from collections.abc import Callable, Iterable
from dataclasses import asdict, dataclass, field, replace
from enum import Enum

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import Cancelled, FailedPrecondition, InvalidArgument, LayerError, Status, Unavailable
from ..functions.fields import payload_bytes, project
from ..functions.hashing import check_shard_count, index_capacity, shard_for, with_shard
from ..functions.wire import decode_frames
from ..operators import maintain, overlay, updates
from ..schema import Schema
from ..sources.artifact import Artifact, Progress, read_shards, write_artifact
from ..sources.files import Files, check_uri
from ..sources.update_log import Consumer, behind, check_poll, merged_progress

#: Keys for each shard that a load's realtime layer has room for at first; catching up makes more room as it needs.
CATCH_UP_CAPACITY = 1_024
#: Messages of a partition in the first round of catching up within a time limit.
FIRST_ROUND = 100_000


class Mode(Enum):
    """Which layers serve."""

    FULL_ONLY = "full_only"
    FULL_WITH_REALTIME = "full_with_realtime"
    FULL_WITH_REALTIME_AND_COMPACTION = "full_with_realtime_and_compaction"

    @property
    def realtime(self) -> bool:
        return self is not Mode.FULL_ONLY

    @property
    def compact(self) -> bool:
        return self is Mode.FULL_WITH_REALTIME_AND_COMPACTION


class LoadCode(Enum):
    UNKNOWN = "unknown"
    PENDING = "pending"
    RUNNING = "running"
    SUCCEEDED = "succeeded"
    FAILED = "failed"
    CANCELLED = "cancelled"


@dataclass(frozen=True)
class ShardProgress:
    shard_id: int
    loaded: bool = False
    prewarmed: bool = False
    cutover: bool = False
    message: str = ""


@dataclass(frozen=True)
class LoadState:
    id: int = 0
    code: LoadCode = LoadCode.UNKNOWN
    artifact_uri: str = ""
    artifact_id: str = ""
    shards: tuple[ShardProgress, ...] = ()
    progress: tuple[Progress, ...] = ()
    last_error: str = ""
    message: str = ""

    @property
    def terminal(self) -> bool:
        return self.code not in (LoadCode.PENDING, LoadCode.RUNNING)

    @property
    def loaded(self) -> int:
        return sum(s.loaded for s in self.shards)

    @property
    def prewarmed(self) -> int:
        return sum(s.prewarmed for s in self.shards)

    @property
    def cutover(self) -> int:
        return sum(s.cutover for s in self.shards)


@dataclass(frozen=True)
class Snapshot:
    """An immutable layer: rows below ``path``, of which this is one shard's part."""

    path: str
    schema: Schema
    rows: int
    artifact_id: str = ""
    settings: maintain.HashSettings | None = None


@dataclass(frozen=True)
class Realtime:
    """A shard's part of a realtime log: messages below the folders, up to no boundary. Folders are only appended to the list."""

    folders: tuple[str, ...]
    schema: Schema
    capacity: int
    stats: updates.DeltaStats = field(default_factory=updates.DeltaStats)


@dataclass(frozen=True)
class Shard:
    shard_id: int
    generation: int = 0
    full: Snapshot | None = None
    compact: Snapshot | None = None
    realtime: Realtime | None = None
    error: str = ""

    @property
    def schema(self) -> Schema | None:
        """The schema that the shard serves: its newest layer's."""
        return next((x.schema for x in (self.realtime, self.compact, self.full) if x), None)


@dataclass(frozen=True)
class Prepared:
    """A checked batch: its folder, and how many keys each shard's realtime layer has with it."""

    folder: str
    keys: dict[int, int]


class Changed(Unavailable):
    """The shards that a publication was made from serve no more."""


#: How often a publication is made again before its caller hears of it.
ATTEMPTS = 50


def _saved(s: Shard) -> dict:
    snapshot = lambda x: x and {"path": x.path, "schema": json.loads(x.schema.to_json()), "rows": x.rows, "artifact_id": x.artifact_id, "settings": x.settings and [x.settings.shards, x.settings.seed, x.settings.version]}
    live = s.realtime and {"folders": list(s.realtime.folders), "schema": json.loads(s.realtime.schema.to_json()), "capacity": s.realtime.capacity, "stats": asdict(s.realtime.stats)}
    return {"shard_id": s.shard_id, "generation": s.generation, "full": snapshot(s.full), "compact": snapshot(s.compact), "realtime": live, "error": s.error}


def _restored(m: dict) -> Shard:
    snapshot = lambda x: x and Snapshot(x["path"], Schema.from_json(x["schema"]), x["rows"], x["artifact_id"], x["settings"] and maintain.HashSettings(*x["settings"]))
    r = m["realtime"]
    live = r and Realtime(tuple(r["folders"]), Schema.from_json(r["schema"]), r["capacity"], updates.DeltaStats(**r["stats"]))
    return Shard(m["shard_id"], m["generation"], snapshot(m["full"]), snapshot(m["compact"]), live, m["error"])


def log_type(schema: Schema) -> T.StructType:
    return T.StructType([
        T.StructField("topic", T.StringType()), T.StructField("partition", T.IntegerType()), T.StructField("offset", T.LongType()), T.StructField("seq", T.LongType()),
        T.StructField("pk", T.LongType()), T.StructField("row", schema.row_type()), T.StructField("shard_id", T.IntegerType()),
    ])


class LayeredIndex:
    def __init__(
        self, spark: SparkSession, work: str, shards: int = 128, seed: int = 0, hash_version: int = 1, mode: Mode = Mode.FULL_WITH_REALTIME_AND_COMPACTION,
        thresholds: maintain.Thresholds = maintain.Thresholds(), consumer: Callable[[], Consumer] | None = None, schemes: tuple[str, ...] = ("file",),
        catch_up_seconds: float | None = None,
    ):
        """``work`` is a folder that the driver and executors share; ``consumer`` makes the consumer that catches up after a load, within ``catch_up_seconds`` if given."""
        self.catch_up_seconds = catch_up_seconds
        self.spark, self.work, self.mode, self.thresholds, self.consumer, self.schemes = spark, work.rstrip("/"), mode, thresholds, consumer, schemes
        self.shards, self.seed, self.hash_version = check_shard_count(shards), seed, hash_version
        self._directory: tuple[Shard, ...] = tuple(Shard(k) for k in range(shards))
        self._lock, self._ids = threading.Lock(), itertools.count(1)
        self._loads: dict[int, LoadState] = {}
        self._cancelled: dict[int, threading.Event] = {}
        self._threads: dict[int, threading.Thread] = {}

    # -- directory -------------------------------------------------------------------------------------------------

    def shard_for(self, key: int) -> int:
        return shard_for(key, self.shards, self.seed, self.hash_version)

    def directory(self) -> tuple[Shard, ...]:
        return self._directory

    def publish(self, *shards: Shard, base: tuple[Shard, ...] | None = None) -> None:
        """Replaces the shards at once. A generation may not fall.

        ``base`` is the directory that they were made from: if one of the shards
        is another by now, nothing is published and ``Changed`` is raised.
        """
        with self._lock:
            now = list(self._directory)
            for s in shards:
                if not 0 <= s.shard_id < self.shards:
                    raise InvalidArgument(f"no shard {s.shard_id}")
                if base is not None and now[s.shard_id] is not base[s.shard_id]:
                    raise Changed(f"shard {s.shard_id} has changed")
                if s.generation < now[s.shard_id].generation:
                    raise FailedPrecondition(f"shard {s.shard_id} has generation {now[s.shard_id].generation} already")
                now[s.shard_id] = s
            self._save(now)
            self._directory = tuple(now)

    def _again(self, attempt: Callable[[], object]) -> object:
        """``attempt``, anew whenever what it was made from has changed."""
        for k in range(ATTEMPTS):
            try:
                return attempt()
            except Changed:
                if k == ATTEMPTS - 1:
                    raise

    def _save(self, shards: list[Shard]) -> None:
        body = {"shards": self.shards, "seed": self.seed, "hash_version": self.hash_version, "mode": self.mode.value, "directory": [_saved(s) for s in shards]}
        Files(self.spark).write_text(f"{self.work}/directory.json", json.dumps(body))

    @classmethod
    def reopen(cls, spark: SparkSession, work: str, **options) -> LayeredIndex:
        """The index as it was last published below ``work``; ``options`` are those of the constructor that are not saved."""
        text = Files(spark).read_text(f"{work.rstrip('/')}/directory.json")
        try:
            m = json.loads(text)
            out = cls(spark, work, m["shards"], m["seed"], m["hash_version"], Mode(m["mode"]), **options)
            directory = tuple(_restored(x) for x in m["directory"])
        except (KeyError, TypeError, ValueError) as e:
            raise InvalidArgument(f"the saved directory is malformed: {e}") from e
        if [s.shard_id for s in directory] != list(range(out.shards)):
            raise InvalidArgument("the saved directory's shards are incomplete")
        out._directory = directory
        return out

    # -- reads -----------------------------------------------------------------------------------------------------

    def _frames(self, shards: Iterable[Shard], kind: str, schema: Schema) -> DataFrame | None:
        """One layer of some shards: shards that share folders are read together."""
        groups: dict[tuple, list[int]] = {}
        layers: dict[tuple, Snapshot | Realtime] = {}
        for s in shards:
            layer = getattr(s, kind)
            if layer is not None:
                key = layer.folders if kind == "realtime" else (layer.path,)
                groups.setdefault(key, []).append(s.shard_id)
                layers[key] = layer
        out = None
        for key, ids in groups.items():
            layer = layers[key]
            if kind != "realtime":
                df = read_shards(self.spark, layer.path, layer.schema, None if len(ids) == self.shards else ids)
            elif not key:
                continue
            else:
                log = self.log(layer, None if len(ids) == self.shards else ids)
                df = updates.latest(log).select("pk", "row")
            df = df.select("pk", "row" if layer.schema == schema else project(layer.schema, schema).alias("row"))
            out = df if out is None else out.unionByName(df)
        return out

    def log(self, layer: Realtime, shards: list[int] | None = None) -> DataFrame:
        if not layer.folders:
            return self.spark.createDataFrame([], log_type(layer.schema))
        df = self.spark.read.schema(log_type(layer.schema)).parquet(*layer.folders)
        return df if shards is None else df.filter(F.col("shard_id").isin(shards))

    def layers(self, shards: Iterable[int] | None = None) -> tuple[list[DataFrame], Schema | None]:
        """The layers that serve, newest first, of all or some shards; and the newest schema among them."""
        now = self._directory
        some = now if shards is None else [now[k] for k in sorted(set(shards))]
        if broken := [s for s in some if s.error]:
            raise FailedPrecondition(broken[0].error)
        schemas = [x.schema for s in some for x in (s.full, s.compact, s.realtime) if x]
        if not schemas:
            return [], None
        schema = max(schemas, key=lambda s: s.version)
        kinds = ["realtime"] * self.mode.realtime + ["compact"] * self.mode.compact + ["full"]
        frames = [self._frames(some, k, schema) for k in kinds]
        return [f for f in frames if f is not None], schema

    def visible(self, fields: list[str] | None = None) -> DataFrame:
        """pk (bit pattern), row of every visible key."""
        layers, _ = self.layers()
        if not layers:
            raise FailedPrecondition("nothing is loaded")
        return overlay.visible(layers, fields)

    def get(self, key: int) -> Row | None:
        """One row, from its shard's folders only."""
        if not 0 <= key < 2**64:
            raise InvalidArgument("a key is an unsigned 64-bit number")
        layers, _ = self.layers([self.shard_for(key)])
        found = overlay.point(layers, key).first() if layers else None
        return found.row if found else None

    def mget(self, keys: list[int]) -> list[Row | None]:
        """Rows in the order of the keys; repeats and misses keep their places."""
        if any(not 0 <= k < 2**64 for k in keys):
            raise InvalidArgument("a key is an unsigned 64-bit number")
        if not keys:
            return []
        layers, _ = self.layers({self.shard_for(k) for k in keys})
        if not layers:
            return [None] * len(keys)
        out: list[Row | None] = [None] * len(keys)
        for r in overlay.lookup(layers, overlay.keys_frame(self.spark, keys), len(keys)).collect():
            out[r.pos] = r.row
        return out

    def lookup(self, keys: DataFrame, n_keys: int | None = None, fields: list[str] | None = None) -> DataFrame:
        """pos, pk, row for a table of (pos, pk); nothing is collected."""
        layers, _ = self.layers()
        if not layers:
            raise FailedPrecondition("nothing is loaded")
        return overlay.lookup(layers, keys, n_keys, fields)

    def prewarm(self) -> None:
        """Reads every column of every layer once, so that file systems and caches hold them."""
        for x in self.layers()[0]:
            x.write.format("noop").mode("overwrite").save()

    # -- updates ---------------------------------------------------------------------------------------------------

    def open_realtime(self, schema: Schema, capacity: int) -> None:
        """Gives every shard an empty realtime layer."""
        if not self.mode.realtime:
            raise FailedPrecondition("this mode has no realtime layer")

        def attempt() -> None:
            now = self._directory
            self.publish(*[replace(s, generation=s.generation + 1, realtime=Realtime((), schema, capacity, updates.DeltaStats(capacity))) for s in now], base=now)

        self._again(attempt)

    def prepared(self, messages: DataFrame, schema: Schema, target: tuple[Shard, ...], bounded: bool = True) -> Prepared:
        """Decodes, checks and writes a batch for ``target``. Nothing is published.

        Of earlier messages only keys and partitions are read, once, and where
        they are: the batch's keys go to them, so the log is not shuffled.
        A batch that is ``bounded`` may not bring a shard more keys than its capacity.
        """
        rows = decode_frames(messages, schema) if "payload" in messages.columns else messages.withColumn("error", F.lit(None).cast("string"))
        dealt = with_shard(rows, self.shards, seed=self.seed, version=self.hash_version)
        folder = f"{self.work}/realtime/{uuid.uuid4().hex}"
        dealt.select("topic", "partition", "offset", "seq", "pk", "row", "shard_id", "error").write.parquet(f"{folder}-checked")
        checked = self.spark.read.parquet(f"{folder}-checked")
        updates.validate(checked)
        known = tuple(sorted({f for s in target if s.realtime for f in s.realtime.folders}))
        checked = checked.withColumn("seq", F.col("seq") + len(known) * updates.BATCH_SEQ)  # later batches arrive later
        kept = checked.drop("error")
        held = {s.shard_id: s.realtime.stats.unique_keys for s in target if s.realtime}
        capacity = {s.shard_id: s.realtime.capacity for s in target if s.realtime}
        for r in self._met(kept, target).collect():  # one row for each shard
            if r.conflict:
                raise FailedPrecondition("updates of one key come from different partitions")
            held[r.shard_id] += r.new
            if bounded and held[r.shard_id] > capacity[r.shard_id]:
                raise FailedPrecondition(f"shard {r.shard_id} holds {held[r.shard_id]} keys, its capacity is {capacity[r.shard_id]}")
        kept.repartitionByRange("shard_id", "pk", "offset").sortWithinPartitions("shard_id", "pk").write.parquet(folder)  # a hot key spreads over tasks
        Files(self.spark).delete(f"{folder}-checked")
        return Prepared(folder, held)

    def _met(self, batch: DataFrame, target: tuple[Shard, ...]) -> DataFrame:
        """shard_id, new, conflict: how many keys of a batch (a written table) the realtime layers lack, and whether any comes from several partitions."""
        spread = [F.min("partition").alias("low"), F.max("partition").alias("high")]
        own = batch.groupBy("shard_id", "pk").agg(*spread)
        logs: dict[tuple[str, ...], tuple[Realtime, list[int]]] = {}
        for s in target:
            if s.realtime and s.realtime.folders:
                logs.setdefault(s.realtime.folders, (s.realtime, []))[1].append(s.shard_id)
        new, low, high = F.lit(1), F.col("low"), F.col("high")
        if logs:
            keys = own.select("shard_id", "pk")
            if batch.count() <= overlay.MOST_BROADCAST:  # a count of files' footers
                keys = F.broadcast(keys)
            past = None
            for layer, ids in logs.values():
                log = self.log(layer, None if len(ids) == self.shards else ids).select("shard_id", "pk", "partition")
                past = log if past is None else past.unionByName(log)
            past = past.join(keys, ["shard_id", "pk"], "left_semi").groupBy("shard_id", "pk").agg(F.min("partition").alias("first"), F.max("partition").alias("last"))
            own = own.join(past, ["shard_id", "pk"], "left")
            new, low, high = F.col("first").isNull().cast("int"), F.least("low", "first"), F.greatest("high", "last")
        return own.groupBy("shard_id").agg(F.sum(new).alias("new"), F.bool_or(low != high).alias("conflict"))

    def with_folder(self, target: tuple[Shard, ...], batch: Prepared, schema: Schema) -> tuple[Shard, ...]:
        """The shards with the batch's folder more in their realtime layer; only the batch is read for their statistics.

        A shard that has more keys than its capacity, by a batch that was not bounded, gets the capacity that they need.
        """
        added = self._counted((batch.folder,), schema)
        out = []
        for s in target:
            n, size = added.get(s.shard_id, (0, 0, 0))[1:]
            old = s.realtime.stats
            slots = old.slot_bytes + n * schema.layout().slot_bytes
            keys = batch.keys[s.shard_id]
            capacity = s.realtime.capacity if keys <= s.realtime.capacity else index_capacity(keys)
            stats = updates.DeltaStats(capacity, keys, old.published_rows + n, slots, old.payload_bytes + size)
            out.append(replace(s, realtime=replace(s.realtime, folders=(*s.realtime.folders, batch.folder), capacity=capacity, stats=stats)))
        return tuple(out)

    def _counted(self, folders: tuple[str, ...], schema: Schema) -> dict[int, tuple[int, int, int]]:
        """Keys, messages and payload bytes of each shard in some folders of a realtime log."""
        if not folders:
            return {}
        log = self.spark.read.schema(log_type(schema)).parquet(*folders)
        n, keys, size = F.count(F.lit(1)).alias("n"), F.count_distinct("pk").alias("keys"), F.sum(payload_bytes(schema)).alias("bytes")
        return {r.shard_id: (r["keys"], r.n, r.bytes) for r in log.groupBy("shard_id").agg(keys, n, size).collect()}  # one row for each shard

    def apply(self, messages: DataFrame) -> dict[tuple[str, int], int]:
        """Applies a batch (topic, partition, offset, seq, pk, payload or row) as a whole; the checkpoint to commit.

        All of the batch is decoded and checked before any of it is published. If
        the shards change meanwhile, it is checked against the new ones.
        """

        def attempt() -> tuple[str, Schema]:
            target = self._directory
            if any(s.realtime is None for s in target):
                raise FailedPrecondition("there is no realtime layer")
            schema = target[0].realtime.schema
            batch = self.prepared(messages, schema, target)
            self.publish(*self.with_folder(target, batch, schema), base=target)
            return batch.folder, schema

        folder, schema = self._again(attempt)
        done = self.spark.read.schema(log_type(schema)).parquet(folder)
        return {(r.topic, r.partition): r.next_offset for r in updates.checkpoint(done).collect()}  # one row for each partition

    def poll_apply_commit(self, consumer: Consumer, max_messages: int = 10_000, timeout_ms: int = 0) -> int:
        """One round: poll, apply, commit. An empty poll commits nothing; a batch that fails is not committed."""
        check_poll(max_messages, timeout_ms)
        batch = consumer.poll(max_messages, timeout_ms)
        if batch is None:
            return 0
        consumer.commit(done := self.apply(batch))
        return len(done)

    # -- maintenance -----------------------------------------------------------------------------------------------

    def stats(self) -> updates.DeltaStats:
        parts = [s.realtime.stats for s in self._directory if s.realtime]
        total = lambda k: sum(getattr(p, k) for p in parts)
        return updates.DeltaStats(total("capacity"), total("unique_keys"), total("published_rows"), total("slot_bytes"), total("payload_bytes"))

    def should_compact(self) -> bool:
        """Whether any shard's realtime layer is over a threshold."""
        return any(maintain.should_compact(s.realtime.stats, s.full.rows if s.full else 0, self.thresholds) for s in self._directory if s.realtime)

    def _written(self, rows: DataFrame, schema: Schema, what: str) -> tuple[str, dict[int, int]]:
        path = f"{self.work}/{what}/{uuid.uuid4().hex}"
        made = write_artifact(rows, path, schema, "", self.shards, self.seed, self.hash_version)
        return path, made.rows

    def compact(self) -> None:
        """Realtime rows and the old compact layer become one compact layer; the realtime layer starts anew.

        Messages that arrive meanwhile stay in the successor's realtime layer.
        """
        if not self.mode.compact:
            raise FailedPrecondition("this mode has no compact layer")
        before = self._directory
        if any(s.realtime is None for s in before):
            raise FailedPrecondition("there is no realtime layer")
        schema = before[0].realtime.schema
        log, old = self.log(before[0].realtime), self._frames(before, "compact", schema)
        newest = updates.latest(log).select("pk", "row")
        path, rows = self._written(newest if old is None else overlay.newer_wins(newest, old), schema, "compact")
        taken = set(before[0].realtime.folders)

        def attempt() -> None:
            now = self._directory
            if any(s.compact is not b.compact or s.realtime is None or s.realtime.schema != schema or not taken.issubset(s.realtime.folders) for s, b in zip(now, before, strict=True)):
                raise FailedPrecondition("the layers that were compacted serve no more")
            left = tuple(f for f in now[0].realtime.folders if f not in taken)
            kept, slot, made = self._counted(left, schema), schema.layout().slot_bytes, []
            for s in now:
                keys, n, size = kept.get(s.shard_id, (0, 0, 0))
                live = replace(s.realtime, folders=left, stats=updates.DeltaStats(s.realtime.capacity, keys, n, n * slot, size))
                made.append(replace(s, generation=s.generation + 1, compact=Snapshot(path, schema, rows[s.shard_id], settings=self._settings()), realtime=live))
            self.publish(*made, base=now)

        self._again(attempt)

    def _settings(self) -> maintain.HashSettings:
        return maintain.HashSettings(self.shards, self.seed, self.hash_version)

    def rebase(self) -> None:
        """Compact rows over full ones become the full layer; no compact layer is left. The realtime layer must be empty."""
        before = self._directory
        if any(s.full is None for s in before):
            raise FailedPrecondition("a rebase needs a full snapshot")
        snapshots = [x for s in before for x in (s.full, s.compact) if x]
        schema = max((x.schema for x in snapshots), key=lambda s: s.version)
        settings = [self._settings(), *(x.settings for x in snapshots if x.settings)]
        loading = any(not s.terminal for s in self._loads.values())
        maintain.check_rebase([x.schema.layout() for x in snapshots], settings, loading, sum(s.realtime.stats.unique_keys for s in before if s.realtime))
        path, rows = self._written(maintain.rebased(self._frames(before, "compact", schema), self._frames(before, "full", schema)), schema, "full")

        def attempt() -> None:
            now = self._directory
            if any(s.full is not b.full or s.compact is not b.compact for s, b in zip(now, before, strict=True)):
                raise FailedPrecondition("the layers that were rebased serve no more")
            full = [Snapshot(path, schema, rows[s.shard_id], s.full.artifact_id, self._settings()) for s in now]
            self.publish(*[replace(s, generation=s.generation + 1, full=f, compact=None) for s, f in zip(now, full, strict=True)], base=now)

        self._again(attempt)

    # -- loads -----------------------------------------------------------------------------------------------------

    def load_async(self, uri: str, artifact_id: str = "") -> int:
        """Begins to load an artifact; the load's id. A bad path is a load that failed at once."""
        load_id = next(self._ids)
        state = LoadState(load_id, LoadCode.PENDING, uri, artifact_id)
        try:
            check_uri(uri, self.schemes)
        except LayerError as e:
            self._loads[load_id] = replace(state, code=LoadCode.FAILED, last_error=str(e), message=str(e))
            return load_id
        self._loads[load_id], self._cancelled[load_id] = state, threading.Event()
        self._threads[load_id] = threading.Thread(target=self._load, args=(load_id,), daemon=True)
        self._threads[load_id].start()
        return load_id

    def load_state(self, load_id: int) -> LoadState:
        return self._loads.get(load_id, LoadState())

    def cancel_load(self, load_id: int) -> bool:
        """Whether there was a load to cancel."""
        if load_id not in self._cancelled or self._loads[load_id].terminal:
            return False
        self._cancelled[load_id].set()
        self.spark.sparkContext.cancelJobsWithTag(f"layerkeep-load-{id(self)}-{load_id}")
        return True

    def wait(self, load_id: int, timeout: float | None = None) -> LoadState:
        if load_id in self._threads:
            self._threads[load_id].join(timeout)
        return self.load_state(load_id)

    def close(self) -> None:
        for k in list(self._cancelled):
            self.cancel_load(k)
        for t in self._threads.values():
            t.join()

    def _note(self, load_id: int, **changes) -> None:
        with self._lock:
            self._loads[load_id] = replace(self._loads[load_id], **changes)

    def _mark(self, load_id: int, shards: Iterable[int], **changes) -> None:
        ids = set(shards)
        state = self._loads[load_id]
        self._note(load_id, shards=tuple(replace(s, **changes) if s.shard_id in ids else s for s in state.shards))

    def _stop_if_cancelled(self, load_id: int) -> None:
        if self._cancelled[load_id].is_set():
            raise Cancelled("the load was cancelled")

    def _load(self, load_id: int) -> None:
        try:
            self.spark.sparkContext.addJobTag(f"layerkeep-load-{id(self)}-{load_id}")
            self._run_load(load_id)
            self._note(load_id, code=LoadCode.SUCCEEDED, message="loaded")
        except Exception as e:  # noqa: BLE001  the state reports it
            gone = self._cancelled[load_id].is_set()
            said = Status.of(e).message
            self._note(load_id, code=LoadCode.CANCELLED if gone else LoadCode.FAILED, last_error="" if gone else said, message="cancelled" if gone else said)

    def _run_load(self, load_id: int) -> None:
        every = range(self.shards)
        state = self._loads[load_id]
        self._note(load_id, code=LoadCode.RUNNING, shards=tuple(ShardProgress(k) for k in every))
        self._stop_if_cancelled(load_id)
        needs = self.mode.realtime
        expected = {"shard_count": self.shards, "hash_seed": self.seed, "hash_version": self.hash_version, "progress_optional": not needs}
        artifact = Artifact.open(self.spark, state.artifact_uri, self.schemes, **expected)
        m = artifact.manifest
        self._note(load_id, artifact_id=state.artifact_id or m.artifact_id)
        artifact.verify(self.spark)
        self._mark(load_id, every, loaded=True)
        self._stop_if_cancelled(load_id)
        artifact.rows(self.spark).write.format("noop").mode("overwrite").save()  # every column once, for the caches of file systems
        self._mark(load_id, every, prewarmed=True)
        own = maintain.HashSettings(m.shard_count, m.hash_seed, m.hash_version)
        full = {k: Snapshot(artifact.path, m.schema, m.rows[k], m.artifact_id, own) for k in every}
        if not needs:
            made = tuple(Shard(k, full=full[k]) for k in every)
        else:
            made = self._caught_up(load_id, tuple(Shard(k, full=full[k], realtime=Realtime((), m.schema, CATCH_UP_CAPACITY, updates.DeltaStats(CATCH_UP_CAPACITY))) for k in every), m)
        for s in made:
            self._stop_if_cancelled(load_id)

            def attempt(s: Shard = s) -> None:
                now = self._directory
                self.publish(replace(s, generation=max(load_id, now[s.shard_id].generation + 1)), base=now)

            try:
                self._again(attempt)
            except Exception as e:
                self._mark(load_id, [s.shard_id], message=str(e))
                raise
            self._mark(load_id, [s.shard_id], cutover=True)

    def _caught_up(self, load_id: int, shards: tuple[Shard, ...], m) -> tuple[Shard, ...]:
        """The new shards after all updates up to the highest end that was seen, however many keys they bring.

        A round takes all that is lacking, so that the log is read a few times
        and not once for each of many small rounds. Within a time limit rounds
        begin small and double, as the clock is looked at between them.
        """
        if not m.progress:
            raise FailedPrecondition("the artifact's source progress is empty")
        if self.consumer is None:
            raise FailedPrecondition("no consumer to catch up with")
        consumer = self.consumer()
        start = {(p.topic, p.partition): p.next_offset for p in m.progress}
        consumer.seek(start)
        consumer.commit(start)
        target = merged_progress(list(m.progress), consumer.progress())
        began, most = time.monotonic(), FIRST_ROUND
        while behind(target):
            self._stop_if_cancelled(load_id)
            if self.catch_up_seconds is not None and time.monotonic() - began > self.catch_up_seconds:
                raise Unavailable("catching up took too long")
            self._note(load_id, progress=tuple(target))
            lacking = max(p.high_watermark - p.next_offset for p in target)
            batch = consumer.poll(lacking if self.catch_up_seconds is None else min(lacking, most))
            most *= 2
            if batch is not None:
                ready = self.prepared(batch, m.schema, shards, bounded=False)
                shards = self.with_folder(shards, ready, m.schema)
                done = self.spark.read.schema(log_type(m.schema)).parquet(ready.folder)
                consumer.commit({(r.topic, r.partition): r.next_offset for r in updates.checkpoint(done).collect()})
            else:
                time.sleep(0.1)
            target = merged_progress(target, consumer.progress())
        self._note(load_id, progress=tuple(target))
        return shards

    # -- status ----------------------------------------------------------------------------------------------------

    def status(self) -> DataFrame:
        """One row for each shard, empty ones too."""
        rows = []
        for s in self._directory:
            schema, st = s.schema, s.realtime.stats if s.realtime else updates.DeltaStats()
            rows.append((
                s.shard_id, s.generation, schema.version if schema else 0, str(schema.layout().fingerprint) if schema else "0", s.full.artifact_id if s.full else "",
                s.realtime is not None, s.compact is not None, s.full is not None, st.capacity, st.unique_keys, st.published_rows, st.slot_bytes, st.payload_bytes, st.load_factor,
                s.compact.rows if s.compact else 0, s.full.rows if s.full else 0, 0, s.error,
            ))
        ddl = (
            "shard_id int, generation long, schema_version long, layout_fingerprint string, artifact_id string, has_realtime boolean, has_compact boolean, has_full boolean, "
            "capacity long, unique_keys long, published_rows long, slot_bytes long, payload_bytes long, load_factor double, compact_rows long, full_rows long, accessor_mismatches long, last_error string"
        )
        return self.spark.createDataFrame(rows, ddl)

    def loads(self) -> list[LoadState]:
        return [self._loads[k] for k in sorted(self._loads)]

    def last_error(self) -> str:
        """The last error of a load, by load id; else the first of a shard."""
        said = [s.last_error for s in self.loads() if s.last_error]
        return said[-1] if said else next((s.error for s in self._directory if s.error), "")
