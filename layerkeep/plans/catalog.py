"""Queries over the driver's tables, one for each operator, and the SQL that each must equal.

``customer`` serves as a full snapshot, ``orders`` as a compact layer (a third of
its keys moved, so that some keys lie in one layer only) and ``events`` as the
update log (key user_id, offset event_id). Money is in whole
cents, so that both engines compare whole numbers.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import FailedPrecondition
from ..functions import fields, hashing, positions, wire
from ..operators import maintain, overlay, updates
from ..schema import Field, Schema
from ..sources.artifact import Artifact, Progress, misplaced_keys, write_artifact
from ..sources.builder import BuildOptions, build
from ..sources.schema_file import SchemaFile, format_schema
from ..sources.files import Files
from ..sources.update_log import ConsumerConfig, LogConsumer
from ..streaming import upserts
from .index import LayeredIndex, Mode

SCHEMA = Schema.of(1, Field(1, "a", "string"), Field(2, "b", "int64"))
SHARDS, SEED = 8, 17
#: Added to the compact layer's keys that are multiples of three.
MOVED = 10_000_000_000


def scratch(spark: SparkSession, what: str) -> str:
    """A folder of its own below the cluster's shared folder (a temporary one where none is set)."""
    held = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not held:
        import tempfile

        if not spark.sparkContext.master.startswith("local"):
            raise FailedPrecondition("a cluster needs spark.checkpoint.dir, a folder that all its machines share")
        spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='layerkeep-')}")
        held = spark.sparkContext.getCheckpointDir()
    return f"{held.rstrip('/')}/layerkeep/{what}-{uuid.uuid4().hex}"


def schemes(path: str) -> tuple[str, ...]:
    return ("file", path.split("://")[0]) if "://" in path else ("file",)


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def cents(column: str):
    return F.round(F.col(column) * 100).cast("long")


def row(a, b):
    return F.struct(a.alias("a"), b.alias("b")).alias("row")


def full_layer(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("pk"), row(F.col("c_mktsegment"), cents("c_acctbal")))


def compact_layer(spark, d):
    key = F.when(F.col("o_custkey") % 3 == 0, F.col("o_custkey") + MOVED).otherwise(F.col("o_custkey"))
    return table(spark, d, "orders").groupBy(key.alias("pk")).agg(F.max_by(row(F.col("o_orderpriority"), cents("o_totalprice")), "o_orderkey").alias("row"))


def event_log(spark, d):
    e = table(spark, d, "events")
    return e.select(F.lit("events").alias("topic"), F.lit(0).alias("partition"), F.col("event_id").alias("offset"), F.col("event_id").alias("seq"), F.col("user_id").alias("pk"), row(F.col("event_type"), cents("value")))


def realtime_layer(spark, d):
    return updates.latest(event_log(spark, d)).select("pk", "row")


def flat(df: DataFrame, *extra: str) -> DataFrame:
    return df.select("pk", F.col("row.a").alias("a"), F.col("row.b").alias("b"), *extra)


# Pieces of the SQL: the three layers with their ranks, newest first.
RT = "SELECT user_id AS pk, max_by(struct_pack(a := event_type, b := CAST(round(value * 100) AS BIGINT)), event_id) AS r FROM events GROUP BY 1"
CD = f"SELECT CASE WHEN o_custkey % 3 = 0 THEN o_custkey + {MOVED} ELSE o_custkey END AS pk, max_by(struct_pack(a := o_orderpriority, b := CAST(round(o_totalprice * 100) AS BIGINT)), o_orderkey) AS r FROM orders GROUP BY 1"
FS = "SELECT c_custkey AS pk, struct_pack(a := c_mktsegment, b := CAST(round(c_acctbal * 100) AS BIGINT)) AS r FROM customer"


def sql_overlay(*layers: str, tail: str = "pk, r.a AS a, r.b AS b, k AS source") -> str:
    united = " UNION ALL ".join(f"SELECT pk, r, {k} AS k FROM ({q})" for k, q in enumerate(layers))
    return f"SELECT {tail} FROM (SELECT *, row_number() OVER (PARTITION BY pk ORDER BY k) AS n FROM ({united})) WHERE n = 1"


# -- overlays and lookups ------------------------------------------------------------------------------------------


def overlay_visible(spark, d):
    return flat(overlay.visible([realtime_layer(spark, d), full_layer(spark, d)], source="source"), "source")


def overlay_three_layers(spark, d):
    return flat(overlay.visible([realtime_layer(spark, d), compact_layer(spark, d), full_layer(spark, d)], source="source"), "source")


def overlay_null_wins(spark, d):
    newest = realtime_layer(spark, d).select("pk", row(F.when(F.col("pk") % 3 != 0, F.col("row.a")), F.col("row.b")))
    return flat(overlay.visible([newest, full_layer(spark, d)]))


def overlay_some_fields(spark, d):
    return overlay.visible([realtime_layer(spark, d), full_layer(spark, d)], fields=["b"]).select("pk", F.col("row.b").alias("b"))


def mode_full_only(spark, d):
    return flat(overlay.visible([full_layer(spark, d)]))


def mode_full_realtime(spark, d):
    return flat(overlay.visible([realtime_layer(spark, d), full_layer(spark, d)]))


def point_get(spark, d):
    return flat(overlay.point([realtime_layer(spark, d), full_layer(spark, d)], 42))


WANTED = [7, 999_999_999, 120, 7, 1_000, 3, 120, 149, 88_888_888]


def mget_order_dups_misses(spark, d):
    found = overlay.lookup([realtime_layer(spark, d), full_layer(spark, d)], overlay.keys_frame(spark, WANTED), len(WANTED))
    return found.select("pos", "pk", F.col("row").isNotNull().alias("found"), F.col("row.a").alias("a"), F.col("row.b").alias("b"))


def mget_table(spark, d):
    """Every order's customer looked up in the three layers: a large batch, joined rather than collected."""
    keys = table(spark, d, "orders").select(F.col("o_orderkey").alias("pos"), F.col("o_custkey").alias("pk"))
    found = overlay.lookup([realtime_layer(spark, d), compact_layer(spark, d), full_layer(spark, d)], keys)
    return found.select("pos", "pk", F.col("row.a").alias("a"), F.col("row.b").alias("b"))


def snapshot_sorted(spark, d):
    rows = overlay.sorted_rows(full_layer(spark, d).withColumn("pk", F.when(F.col("pk") % 2 == 0, F.col("pk")).otherwise(-F.col("pk"))))
    return rows.select(hashing.key_unsigned(F.col("pk")).cast("string").alias("pk"), F.col("row.a").alias("a"))


# -- fields --------------------------------------------------------------------------------------------------------

DEFAULTS = Schema.of(20, Field(1, "segment", "string", default="none"), Field(2, "balance", "int64"), Field(3, "nation", "int32", default=99))


def has_get_default(spark, d):
    c = table(spark, d, "customer")
    values = {"segment": F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")), "balance": F.when(F.col("c_custkey") % 5 != 0, cents("c_acctbal")), "nation": F.when(F.col("c_custkey") % 2 == 0, F.col("c_nationkey"))}
    rows = c.select(F.col("c_custkey").alias("pk"), fields.row_struct(DEFAULTS, values).alias("row"))
    out = [F.col("pk")]
    for f in DEFAULTS.fields:
        out += [fields.has(DEFAULTS, f.field_id).alias(f"has_{f.name}"), fields.accessor(DEFAULTS, f.field_id, f.type).column(DEFAULTS).alias(f.name)]
    return rows.select(*out, fields.has(DEFAULTS, 77).alias("has_unknown"))


LISTS = Schema.of(40, Field(1, "turns", "int64", is_list=True), Field(2, "defaults", "int32", is_list=True, default=[7, 8]), Field(3, "empty", "int32", is_list=True))


def get_list_states(spark, d):
    c = table(spark, d, "conversations").groupBy(F.col("conv_id").alias("pk")).agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    values = {"turns": F.when(F.col("pk") % 4 != 0, F.col("turns")), "defaults": F.when(F.col("pk") % 3 == 0, F.array(F.lit(1))), "empty": F.when(F.col("pk") % 2 == 0, F.array())}
    rows = c.select("pk", fields.row_struct(LISTS, values).alias("row"))
    shown = [F.array_join(F.transform(fields.get_list(LISTS, f.field_id), lambda x: x.cast("string")), ",").alias(f.name) for f in LISTS.fields]
    return rows.select("pk", *shown, fields.has(LISTS, 3).alias("has_empty"))


def schema_add_field(spark, d):
    new = SCHEMA.add_field(Field(3, "c", "int32", default=5), version=2)
    rows = full_layer(spark, d).select("pk", fields.project(SCHEMA, new).alias("row"))
    return rows.select("pk", fields.get(new, 1).alias("a"), fields.has(new, 3).alias("has_c"), fields.get(new, 3).alias("c"))


def schema_delete_field(spark, d):
    new = SCHEMA.delete_field(1, version=2)
    rows = full_layer(spark, d).select("pk", fields.project(SCHEMA, new).alias("row"))
    return rows.select("pk", fields.has(new, 1).alias("has_a"), fields.get(new, 2).alias("b"))


def payload_pool_bytes(spark, d):
    schema = Schema.of(9, Field(1, "text", "string"), Field(2, "turns", "int64", is_list=True), Field(3, "roles", "string", is_list=True, encoding="element_dictionary"), Field(4, "words", "string", is_list=True))
    c = table(spark, d, "conversations").groupBy(F.col("conv_id").alias("pk"))
    rows = c.agg(F.first("text").alias("_"), F.max("text").alias("text"), F.collect_list("turn").alias("turns"), F.collect_list("role").alias("roles"))
    values = {"text": F.col("text"), "turns": F.col("turns"), "roles": F.col("roles"), "words": F.when(F.col("pk") % 2 == 0, F.col("roles"))}
    return rows.select("pk", fields.row_struct(schema, values).alias("row")).select("pk", fields.payload_bytes(schema).alias("bytes"))


# -- updates -------------------------------------------------------------------------------------------------------


def latest_by_offset(spark, d):
    return flat(updates.latest(event_log(spark, d)), "offset")


def late_log(spark, d):
    """The event log in another order of arrival, every fifth message twice."""
    log = event_log(spark, d).withColumn("seq", F.col("offset") % 13 * 1_000_000_000 + F.col("offset"))
    return log.unionByName(log.filter("offset % 5 = 0").withColumn("seq", F.col("seq") + 500_000_000))


LATE = """SELECT user_id AS pk, event_id AS o, event_id % 13 * 1000000000 + event_id AS seq, event_type, value FROM events
UNION ALL SELECT user_id, event_id, event_id % 13 * 1000000000 + event_id + 500000000, event_type, value FROM events WHERE event_id % 5 = 0"""


def classify_positions(spark, d):
    return updates.classified(late_log(spark, d)).select("pk", F.col("offset").alias("o"), "seq", "decision")


def replay_dedup_idempotent(spark, d):
    return flat(updates.latest(late_log(spark, d)), "offset")


def cross_partition_conflicts(spark, d):
    log = event_log(spark, d).withColumn("partition", F.when(F.col("offset") % 50 == 0, 1).otherwise(0))
    return updates.conflicts(log).select("pk", F.col("low").cast("long").alias("low"), F.col("high").cast("long").alias("high"))


def parted_log(spark, d):
    return event_log(spark, d).withColumn("partition", (F.col("offset") % 4).cast("int"))


def commit_checkpoint(spark, d):
    return updates.checkpoint(parted_log(spark, d)).select("topic", F.col("partition").cast("long").alias("part"), "next_offset")


def _progress(spark, d):
    log = parted_log(spark, d)
    ends = updates.checkpoint(log)
    # a consumer that is three messages behind for each partition's number, and has not begun with partition 3
    committed = ends.filter("partition <> 3").withColumn("next_offset", F.greatest(F.lit(0), F.col("next_offset") - 3 * F.col("partition")))
    return updates.lag(committed, ends.withColumnRenamed("next_offset", "high_watermark"))


def partition_lag(spark, d):
    return _progress(spark, d).select("topic", F.col("partition").cast("long").alias("part"), "committed", "high_watermark", "lag")


def catch_up_required(spark, d):
    return updates.catch_up_required(_progress(spark, d))


def capacity_admission(spark, d):
    log = hashing.with_shard(event_log(spark, d), 4, seed=SEED)
    out = updates.within_capacity(log, 20)
    return out.groupBy("shard_id").agg(F.count(F.lit(1)).alias("messages"), F.count_if("fits").alias("admitted"))


def parse_kafka_key(spark, d):
    key = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("x"), F.col("user_id").cast("string"))).when(F.col("event_id") % 5 == 1, F.lit("18446744073709551616"))
    key = key.when(F.col("event_id") % 5 == 2, F.lit("18446744073709551615")).when(F.col("event_id") % 5 == 3, F.concat(F.lit("-"), F.col("user_id").cast("string"))).otherwise(F.col("user_id").cast("string"))
    parsed = positions.parse_key(key)
    return table(spark, d, "events").select("event_id", parsed.cast("string").alias("pk"), hashing.key_bits(parsed).alias("bits"))


# -- maintenance ---------------------------------------------------------------------------------------------------

def boundary(log: DataFrame) -> int:
    """Half of the log is compacted: what arrived before this."""
    last = log.agg(F.max("seq")).first()[0]
    return 0 if last is None else (last + 1) // 2


#: The same in SQL.
HALF = "(SELECT coalesce(max(event_id) + 1, 0) // 2 FROM events)"


def compact_build(spark, d):
    log = event_log(spark, d)
    return flat(maintain.compacted(log, boundary(log), compact_layer(spark, d)))


def rebase_build(spark, d):
    return flat(maintain.rebased(compact_layer(spark, d), full_layer(spark, d)))


def compaction_preserves_reads(spark, d):
    log, full, old = event_log(spark, d), full_layer(spark, d), compact_layer(spark, d)
    before, half = overlay.visible([updates.latest(log).select("pk", "row"), old, full]), boundary(log)
    successor = updates.latest(log.filter(F.col("seq") >= half)).select("pk", "row")
    after = overlay.visible([successor, maintain.compacted(log, half, old), full])
    both = before.select("pk", F.col("row").alias("x")).join(after.select("pk", F.col("row").alias("y")), "pk", "full_outer")
    return both.agg(F.count_if(~F.col("x").eqNullSafe(F.col("y"))).alias("differences"), F.count(F.lit(1)).alias("keys"))


def realtime_to_boundary(spark, d):
    """What a compaction takes."""
    log = event_log(spark, d)
    return flat(updates.latest(log, boundary(log)), "offset")


def post_boundary_visible(spark, d):
    """What stays in the successor's realtime layer after a compaction."""
    log = event_log(spark, d)
    return flat(updates.latest(log.filter(F.col("seq") >= boundary(log))), "offset")


# -- keys, shards, statistics --------------------------------------------------------------------------------------


def stable_hash_shard(spark, d):
    keys = table(spark, d, "orders").select(F.col("o_orderkey").alias("pk"))
    return hashing.with_shard(hashing.with_hash(keys, seed=SEED), SHARDS, seed=SEED).select("pk", "hash", F.col("shard_id").cast("long").alias("shard_id"))


def rows_per_shard(spark, d):
    rows = hashing.with_shard(table(spark, d, "orders").select(F.col("o_orderkey").alias("pk")), SHARDS, seed=SEED)
    every = spark.range(SHARDS).select(F.col("id").cast("int").alias("shard_id"))
    counted = rows.groupBy("shard_id").count()
    return every.join(counted, "shard_id", "left").select(F.col("shard_id").cast("long").alias("shard_id"), F.coalesce("count", F.lit(0)).alias("rows"))


CAPACITY = 4_096


def _stats(spark, d):
    return updates.delta_stats(event_log(spark, d), SCHEMA, CAPACITY)


def delta_stats(spark, d):
    return _stats(spark, d)


def unique_key_ratio(spark, d):
    full = full_layer(spark, d).agg(F.count(F.lit(1)).alias("full_rows"))
    micros = F.when(F.col("full_rows") == 0, 0).otherwise(F.floor(F.col("unique_keys") * 1_000_000 / F.col("full_rows"))).cast("long")
    load = F.floor(F.col("unique_keys") * 1_000_000 / F.col("capacity")).cast("long")
    return _stats(spark, d).crossJoin(full).select("unique_keys", "full_rows", micros.alias("ratio_millionths"), load.alias("load_millionths"))  # one row each


def should_compact(spark, d):
    s = _stats(spark, d).first()
    stats = updates.DeltaStats(s.capacity, s.unique_keys, s.published_rows, s.slot_bytes, s.payload_bytes)
    full = table(spark, d, "customer").count()
    return spark.createDataFrame([(maintain.should_compact(stats, full), maintain.should_compact(stats, 0))], "against_customer boolean, against_nothing boolean")


def duplicate_keys(spark, d):
    key = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pk")
    return overlay.duplicate_keys(table(spark, d, "lineitem").select(key))


def key_validation(spark, d):
    """The keys of an artifact's rows that lie in a wrong shard: every tenth row was moved to the next one."""
    rows = hashing.with_shard(table(spark, d, "orders").select(F.col("o_orderkey").alias("pk")), SHARDS, seed=SEED)
    moved = F.when(F.col("pk") % 10 == 0, (F.col("shard_id") + 1) % SHARDS).otherwise(F.col("shard_id"))
    found = misplaced_keys(rows.withColumn("shard_id", moved.cast("int")), SHARDS, SEED)
    return found.select("pk", F.col("shard_id").cast("long").alias("shard_id"), F.col("own_shard").cast("long").alias("own_shard"))


def pk_violations(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 11 == 0, F.lit(None)).when(F.col("o_orderkey") % 13 == 0, -F.col("o_orderkey")).otherwise(F.col("o_orderkey")).alias("pk"))
    return overlay.bad_keys(rows, "pk")


# -- formats, artifacts, streams -----------------------------------------------------------------------------------


def wire_roundtrip(spark, d):
    framed = wire.encode_rows(full_layer(spark, d), SCHEMA)
    return flat(wire.decode_frames(framed, SCHEMA), "error")


def artifact_roundtrip(spark, d):
    path = scratch(spark, "artifact")
    write_artifact(full_layer(spark, d), path, SCHEMA, "customers", SHARDS, SEED)
    opened = Artifact.open(spark, path, schemes(path), shard_count=SHARDS, hash_seed=SEED)
    opened.verify(spark)
    return flat(opened.rows(spark), F.col("shard_id").cast("long").alias("shard_id"))


def offline_build(spark, d):
    path = scratch(spark, "build")
    schema = Schema.of(11, Field(1, "c_name", "string", nullable=False), Field(2, "c_nationkey", "int32", nullable=False), Field(3, "c_phone", "string"))
    Files(spark).write_text(f"{path}/schema.yaml", format_schema(SchemaFile(schema, "c_custkey", SHARDS, SEED, 1)))
    build(spark, BuildOptions(f"{path}/schema.yaml", f"{d}/customer.parquet", f"{path}/out", "customers"))
    opened = Artifact.open(spark, f"{path}/out", schemes(path))
    out = opened.rows(spark).select("pk", F.col("row.c_name").alias("name"), F.col("row.c_nationkey").alias("nation"), F.col("row.c_phone").isNotNull().alias("has_phone"))
    return out.withColumn("version", F.lit(opened.manifest.schema.version).cast("long"))


def loaded_index(spark, d, mode: Mode, with_events: bool) -> LayeredIndex:
    path = scratch(spark, "index")
    log = f"{path}/messages"
    config = ConsumerConfig("local", "load", ("events",))
    framed = wire.encode_rows(event_log(spark, d).select("topic", "partition", "offset", F.col("pk").cast("string").alias("key"), "row"), SCHEMA)
    progress = (Progress("events", 0, 0, 0),)
    if with_events:
        framed.write.parquet(log)
    write_artifact(full_layer(spark, d), f"{path}/artifact", SCHEMA, "customers", SHARDS, SEED, progress=progress)
    index = LayeredIndex(spark, f"{path}/work", SHARDS, SEED, mode=mode, consumer=lambda: LogConsumer(spark, log, config), schemes=schemes(path))
    index.wait(index.load_async(f"{path}/artifact"))
    if index.last_error():
        raise RuntimeError(index.last_error())
    return index


def load_and_catch_up(spark, d):
    """A load that serves the snapshot and all updates up to the end of the log."""
    return flat(loaded_index(spark, d, Mode.FULL_WITH_REALTIME, True).visible())


def runtime_status(spark, d):
    status = loaded_index(spark, d, Mode.FULL_ONLY, False).status()
    return status.select(F.col("shard_id").cast("long").alias("shard_id"), "has_realtime", "has_compact", "has_full", "full_rows", "schema_version", "artifact_id")


def compact_and_rebase(spark, d):
    """Load, catch up, compact, rebase: what is visible afterwards."""
    index = loaded_index(spark, d, Mode.FULL_WITH_REALTIME_AND_COMPACTION, True)
    index.compact()
    index.rebase()
    return flat(index.visible())


def stream_upserts(spark, d):
    """The event log through Structured Streaming into a realtime layer."""
    path = scratch(spark, "stream")
    framed = wire.encode_rows(event_log(spark, d).select("topic", "partition", "offset", F.col("pk").cast("string").alias("key"), "row"), SCHEMA)
    framed.repartitionByRange(2, "offset").write.parquet(f"{path}/messages")
    index = LayeredIndex(spark, f"{path}/work", SHARDS, SEED, mode=Mode.FULL_WITH_REALTIME)
    index.open_realtime(SCHEMA, 1_000_000)
    upserts.ingest(upserts.messages(spark, f"{path}/messages", 1), [index], f"{path}/checkpoint").awaitTermination()
    return flat(index.visible())


def stream_decisions(spark, d):
    """Every message of the late log against its key's newest position, as state of a stream."""
    name, provider = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    path, held = scratch(spark, "decisions"), spark.conf.get(name)
    late_log(spark, d).select("pk", "partition", "offset", "seq").coalesce(4).write.parquet(f"{path}/messages")
    stream = spark.readStream.schema("pk long, partition int, offset long, seq long").parquet(f"{path}/messages")
    spark.conf.set(name, provider)
    try:
        query = upserts.decisions(stream).writeStream.format("parquet").option("checkpointLocation", f"{path}/checkpoint").option("path", f"{path}/out").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(name, held)
    return spark.read.schema("pk long, partition int, offset long, decision string").parquet(f"{path}/out").select("pk", F.col("offset").alias("o"), "decision")


QUERIES = [
    overlay_visible, overlay_three_layers, overlay_null_wins, overlay_some_fields, mode_full_only, mode_full_realtime, point_get, mget_order_dups_misses, mget_table, snapshot_sorted,
    has_get_default, get_list_states, schema_add_field, schema_delete_field, payload_pool_bytes, latest_by_offset, classify_positions, replay_dedup_idempotent,
    cross_partition_conflicts, commit_checkpoint, partition_lag, catch_up_required, capacity_admission, parse_kafka_key, compact_build, rebase_build,
    compaction_preserves_reads, realtime_to_boundary, post_boundary_visible, stable_hash_shard, rows_per_shard, delta_stats, unique_key_ratio, should_compact, duplicate_keys, key_validation, pk_violations,
    wire_roundtrip, artifact_roundtrip, offline_build, load_and_catch_up, runtime_status, compact_and_rebase, stream_upserts, stream_decisions,
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def hash_sql(key: str, seed: int, version: int = 1) -> str:
    """The stable hash as unsigned 128-bit arithmetic cut to 64 bits, then as a signed number."""
    m = 2**64
    start = seed ^ (version * hashing.VERSION_STEP) % m
    x = f"((xor({key}::UHUGEINT, {start}::UHUGEINT) + {hashing.STEP}::UHUGEINT) % {m}::UHUGEINT)"
    return f"""(SELECT CASE WHEN h > {2**63 - 1}::UHUGEINT THEN (h::HUGEINT - {m}::HUGEINT)::BIGINT ELSE h::BIGINT END FROM (
      SELECT xor(c, c >> 31) AS h FROM (SELECT ((xor(b, b >> 27) * {hashing.SECOND}::UHUGEINT) % {m}::UHUGEINT) AS c FROM (
      SELECT ((xor(a, a >> 30) * {hashing.FIRST}::UHUGEINT) % {m}::UHUGEINT) AS b FROM (SELECT {x} AS a)))))"""


def shard_sql(key: str, shards: int) -> str:
    return f"({hash_sql(key, SEED)} & {shards - 1})"


PROGRESS = """SELECT part, CASE WHEN part = 3 THEN 0 ELSE greatest(0, top - 3 * part) END AS committed, top AS high_watermark FROM (
            SELECT event_id % 4 AS part, max(event_id) + 1 AS top FROM events GROUP BY 1)"""
SLOT = SCHEMA.layout().slot_bytes
KEYED = """CASE event_id % 5 WHEN 0 THEN 'x' || user_id WHEN 1 THEN '18446744073709551616' WHEN 2 THEN '18446744073709551615' WHEN 3 THEN '-' || user_id ELSE user_id::VARCHAR END"""


def oracle_sql() -> dict[str, str]:
    pab = "pk, r.a AS a, r.b AS b"
    newer = lambda new, old: f"SELECT {pab} FROM (SELECT pk, r FROM ({new}) UNION ALL SELECT pk, r FROM ({old}) o WHERE pk NOT IN (SELECT pk FROM ({new})))"
    before = RT.replace("FROM events", f"FROM events WHERE event_id < {HALF}")
    latest = "SELECT user_id AS pk, max_by(event_type, event_id) AS a, max_by(CAST(round(value * 100) AS BIGINT), event_id) AS b, max(event_id) AS \"offset\" FROM events {} GROUP BY 1"
    visible = sql_overlay(RT, FS, tail=pab)
    return {
        "overlay_visible": sql_overlay(RT, FS),
        "overlay_three_layers": sql_overlay(RT, CD, FS),
        "overlay_null_wins": sql_overlay(f"SELECT pk, struct_pack(a := CASE WHEN pk % 3 <> 0 THEN r.a END, b := r.b) AS r FROM ({RT})", FS, tail=pab),
        "overlay_some_fields": sql_overlay(RT, FS, tail="pk, r.b AS b"),
        "mode_full_only": f"SELECT {pab} FROM ({FS})",
        "mode_full_realtime": visible,
        "point_get": f"SELECT * FROM ({visible}) WHERE pk = 42",
        "mget_order_dups_misses": f"SELECT w.pos, w.pk, v.pk IS NOT NULL AS found, v.a, v.b FROM (VALUES {', '.join(f'({i}::BIGINT, {k}::BIGINT)' for i, k in enumerate(WANTED))}) w(pos, pk) LEFT JOIN ({visible}) v USING (pk)",
        "mget_table": f"SELECT o_orderkey AS pos, o_custkey AS pk, v.a, v.b FROM orders LEFT JOIN ({sql_overlay(RT, CD, FS, tail=pab)}) v ON v.pk = o_custkey",
        "snapshot_sorted": "SELECT (CASE WHEN c_custkey % 2 = 0 THEN c_custkey::HUGEINT ELSE 18446744073709551616::HUGEINT - c_custkey END)::VARCHAR AS pk, c_mktsegment AS a FROM customer",
        "has_get_default": """SELECT c_custkey AS pk, c_custkey % 3 <> 0 AS has_segment, CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment ELSE 'none' END AS segment,
            c_custkey % 5 <> 0 AS has_balance, CASE WHEN c_custkey % 5 <> 0 THEN CAST(round(c_acctbal * 100) AS BIGINT) END AS balance,
            c_custkey % 2 = 0 AS has_nation, CASE WHEN c_custkey % 2 = 0 THEN c_nationkey ELSE 99 END AS nation, false AS has_unknown FROM customer""",
        "get_list_states": """SELECT conv_id AS pk, CASE WHEN conv_id % 4 <> 0 THEN string_agg(turn::VARCHAR, ',' ORDER BY turn) ELSE '' END AS turns,
            CASE WHEN conv_id % 3 = 0 THEN '1' ELSE '7,8' END AS defaults, '' AS empty, conv_id % 2 = 0 AS has_empty FROM conversations GROUP BY conv_id""",
        "schema_add_field": "SELECT c_custkey AS pk, c_mktsegment AS a, false AS has_c, 5 AS c FROM customer",
        "schema_delete_field": "SELECT c_custkey AS pk, false AS has_a, CAST(round(c_acctbal * 100) AS BIGINT) AS b FROM customer",
        "payload_pool_bytes": """SELECT conv_id AS pk, CAST(strlen(max(text)) + 8 * count(turn) + 4 * count(role) + sum(strlen(role))
            + CASE WHEN conv_id % 2 = 0 THEN 16 * count(role) + sum(strlen(role)) ELSE 0 END AS BIGINT) AS bytes FROM conversations GROUP BY conv_id""",
        "latest_by_offset": latest.format(""),
        "classify_positions": f"""SELECT pk, o, seq, CASE WHEN o < cur THEN 'stale' WHEN o = cur THEN 'idempotent' ELSE 'newer' END AS decision FROM (
            SELECT *, max(o) OVER (PARTITION BY pk ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS cur FROM ({LATE}))""",
        "replay_dedup_idempotent": latest.format(""),
        "cross_partition_conflicts": """SELECT user_id AS pk, min(p) AS low, max(p) AS high FROM (SELECT user_id, CASE WHEN event_id % 50 = 0 THEN 1 ELSE 0 END::BIGINT AS p FROM events)
            GROUP BY 1 HAVING min(p) <> max(p)""",
        "commit_checkpoint": "SELECT 'events' AS topic, event_id % 4 AS part, max(event_id) + 1 AS next_offset FROM events GROUP BY 2",
        "partition_lag": f"SELECT 'events' AS topic, part, committed, high_watermark, high_watermark - committed AS lag FROM ({PROGRESS})",
        "catch_up_required": f"SELECT bool_or(committed < high_watermark) AS required FROM ({PROGRESS})",
        "capacity_admission": f"""WITH k AS (SELECT user_id, min(event_id) AS f, count(*) AS n FROM events GROUP BY 1),
            s AS (SELECT *, {shard_sql('user_id', 4)}::INTEGER AS shard_id FROM k),
            r AS (SELECT *, row_number() OVER (PARTITION BY shard_id ORDER BY f) AS place FROM s)
            SELECT shard_id, sum(n)::BIGINT AS messages, coalesce(sum(n) FILTER (WHERE place <= 20), 0)::BIGINT AS admitted FROM r GROUP BY 1""",
        "parse_kafka_key": f"""SELECT event_id, u::VARCHAR AS pk, CASE WHEN u > 9223372036854775807 THEN (u - 18446744073709551616)::BIGINT ELSE u::BIGINT END AS bits FROM (
            SELECT event_id, CASE WHEN v <= 18446744073709551615 THEN v END AS u FROM (
            SELECT event_id, CASE WHEN regexp_full_match(k, '[0-9]+') THEN TRY_CAST(k AS HUGEINT) END AS v FROM (SELECT event_id, {KEYED} AS k FROM events)))""",
        "compact_build": newer(before, CD),
        "rebase_build": newer(CD, FS),
        "compaction_preserves_reads": f"SELECT 0::BIGINT AS differences, count(*) AS keys FROM ({sql_overlay(RT, CD, FS)})",
        "realtime_to_boundary": latest.format(f"WHERE event_id < {HALF}"),
        "post_boundary_visible": latest.format(f"WHERE event_id >= {HALF}"),
        "key_validation": f"""SELECT o_orderkey AS pk, (s + 1) % {SHARDS} AS shard_id, s AS own_shard FROM (SELECT o_orderkey, {shard_sql('o_orderkey', SHARDS)} AS s FROM orders WHERE o_orderkey % 10 = 0)""",
        "stream_decisions": f"""SELECT pk, o, CASE WHEN o < cur THEN 'stale' WHEN o = cur THEN 'idempotent' ELSE 'newer' END AS decision FROM (
            SELECT *, max(o) OVER (PARTITION BY pk ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS cur FROM ({LATE}))""",
        "stable_hash_shard": f"SELECT o_orderkey AS pk, {hash_sql('o_orderkey', SEED)} AS hash, {shard_sql('o_orderkey', SHARDS)} AS shard_id FROM orders",
        "rows_per_shard": f"SELECT s AS shard_id, count(k) AS rows FROM range({SHARDS}) t(s) LEFT JOIN (SELECT {shard_sql('o_orderkey', SHARDS)} AS k FROM orders) ON k = s GROUP BY s",
        "delta_stats": f"""SELECT {CAPACITY}::BIGINT AS capacity, count(DISTINCT user_id) AS unique_keys, count(*) AS published_rows, count(*) * {SLOT} AS slot_bytes,
            sum(strlen(event_type))::BIGINT AS payload_bytes FROM events""",
        "unique_key_ratio": f"""SELECT u AS unique_keys, n AS full_rows, floor(u * 1000000 / n)::BIGINT AS ratio_millionths, floor(u * 1000000 / {CAPACITY})::BIGINT AS load_millionths
            FROM (SELECT count(DISTINCT user_id) AS u FROM events), (SELECT count(*) AS n FROM customer)""",
        "should_compact": f"""SELECT big OR u >= 0.05 * n AS against_customer, big AS against_nothing FROM (
            SELECT count(DISTINCT user_id) AS u, count(DISTINCT user_id) >= 0.6 * {CAPACITY} OR count(*) * {SLOT} >= 67108864 OR sum(strlen(event_type)) >= 67108864 AS big FROM events),
            (SELECT count(*) AS n FROM customer)""",
        "duplicate_keys": "SELECT l_orderkey * 10 + l_linenumber AS pk, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1",
        "pk_violations": """SELECT * FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 13 = 0 THEN -o_orderkey ELSE o_orderkey END AS pk FROM orders)
            WHERE pk IS NULL OR pk < 0""",
        "wire_roundtrip": f"SELECT {pab}, NULL::VARCHAR AS error FROM ({FS})",
        "artifact_roundtrip": f"SELECT {pab}, {shard_sql('pk', SHARDS)} AS shard_id FROM ({FS})",
        "offline_build": "SELECT c_custkey AS pk, c_name AS name, c_nationkey AS nation, false AS has_phone, 12::BIGINT AS version FROM customer",
        "load_and_catch_up": visible,
        "runtime_status": f"""SELECT s AS shard_id, false AS has_realtime, false AS has_compact, true AS has_full, count(k) AS full_rows, 1::BIGINT AS schema_version, 'customers' AS artifact_id
            FROM range({SHARDS}) t(s) LEFT JOIN (SELECT {shard_sql('c_custkey', SHARDS)} AS k FROM customer) ON k = s GROUP BY s""",
        "compact_and_rebase": visible,
        "stream_upserts": f"SELECT {pab} FROM ({RT})",
    }
