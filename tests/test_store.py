"""Layers, lookups, ordering, artifacts, loads and streams on small cases."""

import random
import threading
import time
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from layerkeep.errors import FailedPrecondition, InvalidArgument, NotFound
from layerkeep.functions import fields, hashing, positions, wire
from layerkeep.operators import maintain, overlay, updates
from layerkeep.plans.index import CATCH_UP_CAPACITY, Changed, LayeredIndex, LoadCode, Mode
from layerkeep.schema import Field, Schema
from layerkeep.sources import artifact, builder, fixtures, parquet_rows, schema_file, update_log
from layerkeep.sources.artifact import Artifact, Progress, write_artifact
from layerkeep.sources.update_log import ConsumerConfig, LogConsumer
from layerkeep.streaming import upserts

S = Schema.of(900, Field(1, "score", "int32"), Field(2, "title", "string"))
ROW = "pk long, row struct<score:int,title:string>"


def layer(spark, rows):
    return spark.createDataFrame([(k, v) for k, v in rows.items()], ROW)


def seen(df):
    return {r.pk: tuple(r.row) for r in df.select("pk", "row").collect()}


REALTIME, COMPACT, FULL = {1: (30, "realtime"), 4: (60, "rt-only")}, {1: (20, None), 2: (40, None)}, {1: (10, "full"), 2: (35, "full"), 3: (50, "full-only")}


def test_precedence(spark):
    layers = [layer(spark, x) for x in (REALTIME, COMPACT, FULL)]
    assert seen(overlay.visible(layers)) == {1: (30, "realtime"), 2: (40, None), 3: (50, "full-only"), 4: (60, "rt-only")}
    keys = [4, 99, 2, 1, 4, 3]
    rows = overlay.lookup(layers, overlay.keys_frame(spark, keys), len(keys)).orderBy("pos").collect()
    assert [r.row and r.row.score for r in rows] == [60, None, 40, 30, 60, 50]
    assert [r.pk for r in rows] == keys


def test_filters_and_fields_reach_the_scans(spark, tmp_path):
    paths = []
    for i, x in enumerate((REALTIME, FULL)):
        layer(spark, x).write.parquet(f"{tmp_path}/{i}")
        paths.append(spark.read.parquet(f"{tmp_path}/{i}"))
    point = overlay.point(paths, 3)._jdf.queryExecution().toString()
    assert point.count("EqualTo(pk,3)") >= 2
    some = overlay.visible(paths, fields=["score"])._jdf.queryExecution().executedPlan().toString()
    assert "title" not in some


def test_random_log_against_a_dictionary(spark):
    rng = random.Random(5)
    log, newest, old = [], {}, {k: (k, "old") for k in range(0, 60, 3)}
    for seq in range(3000):
        pk, offset = rng.randrange(50), rng.randrange(2000)
        log.append(("t", 0, offset, seq, pk, (seq, f"v{seq}")))
        if seq < 2000 and (pk not in newest or offset > newest[pk][0]):
            newest[pk] = offset, (seq, f"v{seq}")
    df = spark.createDataFrame(log, "topic string, partition int, offset long, seq long, " + ROW)
    want = {k: v[1] for k, v in newest.items()}
    assert seen(updates.latest(df, 2000)) == want
    assert seen(maintain.compacted(df, 2000, layer(spark, old))) == old | want
    decided = updates.classified(df).filter("seq < 2000 and decision = 'newer'").groupBy("pk").agg(F.max("offset").alias("o")).collect()
    assert {r.pk: r.o for r in decided} == {k: v[0] for k, v in newest.items()}


def test_field_states(spark):
    s = Schema.of(20, Field(1, "age", "int32", default=99), Field(2, "flag", "bool"), Field(3, "counter", "int64", nullable=False), Field(4, "tags", "int32", True), Field(5, "more", "int32", True, default=[7, 8]))
    df = spark.createDataFrame([((None, None, 123, [], None),)], f"row {s.row_type().simpleString()}")
    got = df.select(*[fields.has(s, i).alias(f"h{i}") for i in (1, 2, 3, 4, 5, 77)], *[fields.get(s, i).alias(f"g{i}") for i in (1, 2, 3)], *[fields.get_list(s, i).alias(f"l{i}") for i in (4, 5)]).first()
    assert tuple(got) == (False, False, True, True, False, False, 99, None, 123, [], [7, 8])
    with pytest.raises(InvalidArgument):
        fields.get(s, 1, "string")
    with pytest.raises(InvalidArgument):
        fields.get(s, 4)
    a = fields.accessor(s, 1, "int32")
    with pytest.raises(FailedPrecondition):
        a.column(Schema.of(21, *s.fields))
    with pytest.raises(InvalidArgument):
        fields.accessor(s.delete_field(1), 1)


def test_unsigned_keys(spark):
    keys = [0, 1, 2**63 - 1, 2**63, 2**64 - 1]
    df = spark.createDataFrame([(str(k),) for k in keys], "t string").select("t", hashing.key_bits(F.col("t").cast("decimal(20,0)")).alias("pk"))
    rows = hashing.with_hash(df, seed=17).select("t", "hash", hashing.key_unsigned(F.col("pk")).cast("string").alias("back"), hashing.unsigned_order(F.col("pk")).alias("o")).collect()
    assert all(r.t == r.back and hashing.unsigned(r.hash) == hashing.stable_hash(int(r.t), 17) for r in rows)
    assert [r.t for r in overlay.sorted_rows(df).collect()] == [str(k) for k in keys]
    assert sorted(rows, key=lambda r: r.o) == sorted(rows, key=lambda r: int(r.t))
    assert spark.conf.get("spark.sql.ansi.enabled") == "true"


def test_validation_of_batches(spark):
    kind = "topic string, partition int, offset long, seq long, pk long"
    updates.validate(spark.createDataFrame([], kind))
    for rows in ([("a", 0, 1, 1, 1), ("b", 0, 2, 2, 1)], [("a", -1, 1, 1, 1)], [("a", 0, -1, 1, 1)], [("a", 0, 2**63 - 1, 1, 1)], [("a", 0, 1, 1, None)]):
        with pytest.raises(InvalidArgument):
            updates.validate(spark.createDataFrame(rows, kind))


def test_thresholds():
    assert maintain.should_compact(updates.DeltaStats(10, 6), 0)
    assert maintain.should_compact(updates.DeltaStats(1000, 1), 20)
    assert not maintain.should_compact(updates.DeltaStats(1000, 1, 5, 100, 100), 21)
    assert maintain.should_compact(updates.DeltaStats(1000, 1, 5, 64 << 20, 0), 0)
    assert maintain.should_rebase(10, 0, 100) and not maintain.should_rebase(9, 0, 100)
    with pytest.raises(FailedPrecondition):
        maintain.rebased(None, None)
    a = [S.layout()]
    for bad in ((a + [Schema.of(1).layout()], [maintain.HashSettings(2)], False, 0), (a, [maintain.HashSettings(2), maintain.HashSettings(4)], False, 0), (a, [], True, 0), (a, [], False, 3)):
        with pytest.raises(FailedPrecondition):
            maintain.check_rebase(*bad)


# -- sources -------------------------------------------------------------------------------------------------------


def test_strict_reading(spark, tmp_path):
    s = Schema.of(1, Field(1, "score", "int32", nullable=False), Field(2, "tags", "string", True))
    good = spark.createDataFrame([(1, 10, ["a"], "x"), (2, 20, None, "y")], "id long, score int, tags array<string>, extra string")
    good.write.parquet(f"{tmp_path}/in/dt=2026-05-03")
    good.select("id", "score").withColumn("id", F.col("id") + 10).write.parquet(f"{tmp_path}/in/more")
    rows = parquet_rows.read_rows(spark, f"{tmp_path}/in", s, "id")
    assert seen(rows) == {1: (10, ["a"]), 2: (20, None), 11: (10, None), 12: (20, None)}
    bad = {
        "wide": good.withColumn("score", F.col("score").cast("long")), "null": good.withColumn("score", F.when(F.col("id") > 1, 1)), "element": good.withColumn("tags", F.array(F.lit(None).cast("string"))),
        "negative": good.withColumn("id", -F.col("id")), "no key": good.drop("id"), "no score": good.drop("score"), "key type": good.withColumn("id", F.col("id").cast("int")),
    }
    for name, df in bad.items():
        df.write.parquet(f"{tmp_path}/{name}")
        with pytest.raises(InvalidArgument):
            parquet_rows.read_rows(spark, f"{tmp_path}/{name}", s, "id")
    good.write.parquet(f"{tmp_path}/types/a")
    good.withColumn("id", F.col("id") + 50).withColumn("score", F.col("score").cast("long")).write.parquet(f"{tmp_path}/types/b")
    with pytest.raises(InvalidArgument):
        parquet_rows.read_rows(spark, f"{tmp_path}/types", s, "id")
    good.union(good).write.parquet(f"{tmp_path}/twice")
    with pytest.raises(FailedPrecondition):
        parquet_rows.read_rows(spark, f"{tmp_path}/twice", s, "id")
    with pytest.raises(NotFound):
        parquet_rows.parquet_files(spark, f"{tmp_path}/nowhere")


def test_build_of_all_types(spark, tmp_path):
    s = fixtures.all_types()
    made = fixtures.generate(spark, 500)
    made.write.parquet(f"{tmp_path}/in")
    (tmp_path / "schema.yaml").write_text(schema_file.format_schema(schema_file.SchemaFile(s, "item", 4, 17, 1)))
    done = builder.build(spark, builder.BuildOptions(f"{tmp_path}/schema.yaml", f"{tmp_path}/in", f"{tmp_path}/out", "x"))
    assert (done.rows, done.manifest.schema.version, set(done.rows_by_shard)) == (500, 4, {0, 1, 2, 3})
    opened = Artifact.open(spark, f"file://{tmp_path}/out", shard_count=4, hash_seed=17)
    opened.verify(spark)
    opened.check_keys(spark)
    ours = opened.rows(spark).select("pk", "row.*")
    theirs = made.select(hashing.key_bits(F.col("item")).alias("pk"), *[f.name for f in s.fields])
    assert ours.exceptAll(theirs).count() == 0 and theirs.exceptAll(ours).count() == 0
    assert schema_file.read(spark, f"{tmp_path}/out/schema.yaml").schema.version == 4
    with pytest.raises(FailedPrecondition):
        builder.build(spark, builder.BuildOptions(f"{tmp_path}/schema.yaml", f"{tmp_path}/in", f"{tmp_path}/out", "x"))


def test_artifacts_fail_closed(spark, tmp_path):
    path = f"{tmp_path}/a"
    write_artifact(layer(spark, FULL), path, S, "a", 4, 5, progress=(Progress("t", 0, 5, 8),))
    opened = Artifact.open(spark, path)
    assert opened.manifest.progress == (Progress("t", 0, 5, 8),) and sum(opened.manifest.rows.values()) == 3
    for expected in ({"shard_count": 8}, {"hash_seed": 6}, {"hash_version": 2}):
        with pytest.raises(FailedPrecondition):
            Artifact.open(spark, path, **expected)
    text = (tmp_path / "a/manifest.json").read_text()
    with pytest.raises((FailedPrecondition, InvalidArgument)):
        artifact.parse_manifest(text.replace('"artifact_id": "a"', '"artifact_id": "b"'))
    with pytest.raises(InvalidArgument):
        artifact.parse_manifest("{}")
    for bad in ("", "s3://x/y", "file://"):
        with pytest.raises(InvalidArgument):
            Artifact.open(spark, bad)
    with pytest.raises(InvalidArgument):
        write_artifact(layer(spark, FULL), f"{tmp_path}/b", S, "b", 4, progress=(Progress("t", 0, 5, 8), Progress("t", 0, 6, 8)))
    opened.check_keys(spark)
    layer(spark, {77: (1, "more")}).withColumn("shard_id", F.lit(0)).write.mode("append").partitionBy("shard_id").parquet(f"{path}/rows")
    with pytest.raises(FailedPrecondition):
        opened.verify(spark)
    write_artifact(layer(spark, FULL), f"{tmp_path}/c", S, "c", 2, bloom=True)
    moved = Artifact.open(spark, f"{tmp_path}/c")
    k = moved.rows(spark).first()
    layer(spark, {k.pk: (0, "again")}).withColumn("shard_id", F.lit(1 - k.shard_id)).write.mode("append").partitionBy("shard_id").parquet(f"{tmp_path}/c/rows")
    with pytest.raises(FailedPrecondition):
        moved.check_keys(spark)


def test_catching_up_may_take_too_long(spark, tmp_path):
    path, log = f"{tmp_path}/full", f"{tmp_path}/log"
    write_artifact(layer(spark, FULL), path, S, "a", 2, 7, progress=(Progress("t", 0, 0, 9),))
    index = LayeredIndex(spark, f"{tmp_path}/w", 2, 7, consumer=lambda: LogConsumer(spark, log, ConsumerConfig("local", "g", ("t",))), catch_up_seconds=0.3)
    state = index.wait(index.load_async(path))
    assert state.code is LoadCode.FAILED and "too long" in state.last_error
    slow = LayeredIndex(spark, f"{tmp_path}/w2", 2, 7, consumer=lambda: LogConsumer(spark, log, ConsumerConfig("local", "g", ("t",))))
    load = slow.load_async(path)
    assert slow.cancel_load(load) and slow.wait(load).code is LoadCode.CANCELLED and not slow.load_state(load).cutover
    slow.close()


# -- index ---------------------------------------------------------------------------------------------------------


def messages(spark, rows, schema=S):
    """(partition, offset, key, row) as a batch in order of arrival."""
    framed = [("t", p, o, i, k, None if r is None else bytearray(wire.encode_row(schema, r))) for i, (p, o, k, r) in enumerate(rows)]
    return spark.createDataFrame(framed, "topic string, partition int, offset long, seq long, pk long, payload binary")


@pytest.fixture
def snapshot(spark, tmp_path):
    path = f"{tmp_path}/full"
    write_artifact(layer(spark, {k: (k * 10, "full") for k in range(20)}), path, S, "full-1", 2, 7, progress=(Progress("t", 0, 0, 0),))
    return path


def test_full_only_load_and_replacement(spark, tmp_path, snapshot):
    index = LayeredIndex(spark, f"{tmp_path}/w", 2, 7, mode=Mode.FULL_ONLY)
    assert index.get(3) is None and index.mget([1, 2]) == [None, None]
    state = index.wait(index.load_async(snapshot, "mine"))
    assert (state.code, state.artifact_id, state.loaded, state.prewarmed, state.cutover) == (LoadCode.SUCCEEDED, "mine", 2, 2, 2)
    assert index.get(3).score == 30 and index.get(99) is None
    assert [r and r.score for r in index.mget([5, 99, 5, 0])] == [50, None, 50, 0]
    old = index.visible()
    write_artifact(layer(spark, {1: (1, "new")}), f"{tmp_path}/two", S, "full-2", 2, 7)
    assert index.wait(index.load_async(f"file://{tmp_path}/two")).code is LoadCode.SUCCEEDED
    assert index.get(3) is None and index.get(1).title == "new"
    assert old.count() == 20  # planned before the cutover
    status = index.status().collect()
    assert [r.full_rows for r in status] == [sum(index.shard_for(1) == k for _ in [0]) for k in range(2)] and all(r.artifact_id == "full-2" for r in status)


def test_failed_loads_leave_what_serves(spark, tmp_path, snapshot):
    index = LayeredIndex(spark, f"{tmp_path}/w", 2, 7, mode=Mode.FULL_ONLY)
    index.wait(index.load_async(snapshot))
    for bad in ("", "http://x", f"{tmp_path}/none"):
        state = index.wait(index.load_async(bad))
        assert state.code is LoadCode.FAILED and state.last_error and state.terminal
    assert index.get(3).score == 30 and index.last_error()
    assert index.load_state(99).code is LoadCode.UNKNOWN and not index.cancel_load(99) and not index.cancel_load(1)
    other = LayeredIndex(spark, f"{tmp_path}/w2", 2, 8, mode=Mode.FULL_ONLY)
    assert other.wait(other.load_async(snapshot)).code is LoadCode.FAILED
    realtime = LayeredIndex(spark, f"{tmp_path}/w3", 2, 7)
    state = realtime.wait(realtime.load_async(snapshot))
    assert (state.code, state.loaded, state.cutover) == (LoadCode.FAILED, 2, 0)


def test_catch_up_maintenance_and_evolution(spark, tmp_path, snapshot):
    log = f"{tmp_path}/log"
    batch = messages(spark, [(0, 0, 3, {"score": 1, "title": "rt"}), (0, 1, 50, {"score": 2})])
    batch.select("topic", "partition", "offset", F.col("pk").cast("string").alias("key"), "payload").write.parquet(log)
    index = LayeredIndex(spark, f"{tmp_path}/w", 2, 7, consumer=lambda: LogConsumer(spark, log, ConsumerConfig("local", "g", ("t",))))
    state = index.wait(index.load_async(snapshot))
    assert state.code is LoadCode.SUCCEEDED and state.progress == (Progress("t", 0, 2, 2),)
    index.prewarm()
    assert tuple(index.get(3)) == (1, "rt") and tuple(index.get(50)) == (2, None) and index.get(4).score == 40
    assert index.apply(messages(spark, [(0, 1, 3, {"score": 9}), (0, 5, 4, {"score": 8})])) == {("t", 0): 6}
    before = seen(index.visible())
    with pytest.raises(FailedPrecondition):
        index.rebase()  # realtime rows are left
    index.compact()
    assert seen(index.visible()) == before and index.stats().unique_keys == 0
    index.rebase()
    assert seen(index.visible()) == before and not any(r.has_compact for r in index.status().collect())
    newer = S.add_field(Field(3, "c", "int32", default=5), version=901)
    index.open_realtime(newer, 100)
    index.apply(messages(spark, [(0, 9, 7, {"score": 1, "c": 6})], newer))
    _, schema = index.layers()
    got = {r.pk: r.c for r in index.visible().select("pk", fields.get(schema, 3).alias("c")).collect()}
    assert schema.version == 901 and got[7] == 6 and got[8] == 5


def test_catching_up_brings_more_keys_than_there_was_room_for(spark, tmp_path, snapshot):
    log, n = f"{tmp_path}/log", 2 * CATCH_UP_CAPACITY + 400
    framed = spark.range(n).select((F.col("id") + 5).alias("pk"), F.struct(F.col("id").cast("int").alias("score"), F.lit("rt").alias("title")).alias("row"), F.col("id").alias("offset"))
    wire.encode_rows(framed.select(F.lit("t").alias("topic"), F.lit(0).alias("partition"), "offset", F.col("pk").cast("string").alias("key"), "row"), S).write.parquet(log)
    index = LayeredIndex(spark, f"{tmp_path}/w", 2, 7, consumer=lambda: LogConsumer(spark, log, ConsumerConfig("local", "g", ("t",))))
    state = index.wait(index.load_async(snapshot))
    assert (state.code, state.last_error, state.progress) == (LoadCode.SUCCEEDED, "", (Progress("t", 0, n, n),))
    want = {k: (k * 10, "full") for k in range(5)} | {k + 5: (k, "rt") for k in range(n)}
    assert seen(index.visible()) == want and index.stats().unique_keys == n
    live = [s.realtime for s in index.directory()]
    assert all(CATCH_UP_CAPACITY < r.stats.unique_keys <= r.capacity == r.stats.capacity for r in live)
    room = live[0].capacity - live[0].stats.unique_keys
    more = [k for k in range(10_000, 20_000) if index.shard_for(k) == 0][: room + 1]
    with pytest.raises(FailedPrecondition):  # later batches keep to the capacity
        index.apply(messages(spark, [(0, n + i, k, {"score": 1}) for i, k in enumerate(more)]))
    index.apply(messages(spark, [(0, n + i, k, {"score": 1}) for i, k in enumerate(more[:-1])]))
    want |= {k: (1, None) for k in more[:-1]}
    index.compact()
    index.rebase()
    assert seen(index.visible()) == want


def test_catching_up_takes_all_that_is_lacking_in_a_round(spark, tmp_path, snapshot, monkeypatch):
    log, n = f"{tmp_path}/log", 3_000
    framed = spark.range(n).select(F.lit("t").alias("topic"), F.lit(0).alias("partition"), F.col("id").alias("offset"), (F.col("id") % 100).cast("string").alias("key"), F.struct(F.col("id").cast("int").alias("score"), F.lit(None).cast("string").alias("title")).alias("row"))
    wire.encode_rows(framed, S).write.parquet(log)
    polls = []

    class Counting(LogConsumer):
        def poll(self, max_messages, timeout_ms=0):
            out = super().poll(max_messages, timeout_ms)
            plan = out._jdf.queryExecution().sparkPlan().toString()
            polls.append((max_messages, out.count(), "Window" in plan or "Sort" in plan))
            return out

    index = LayeredIndex(spark, f"{tmp_path}/w", 2, 7, consumer=lambda: Counting(spark, log, ConsumerConfig("local", "g", ("t",))))
    assert index.wait(index.load_async(snapshot)).progress == (Progress("t", 0, n, n),)
    assert polls == [(n, n, False)]
    want = {k: (n - 100 + k, None) for k in range(100)}
    assert seen(index.visible()) == want
    polls.clear()  # a limit of time: the clock is looked at between rounds
    monkeypatch.setattr("layerkeep.plans.index.FIRST_ROUND", 700)
    timed = LayeredIndex(spark, f"{tmp_path}/w2", 2, 7, consumer=lambda: Counting(spark, log, ConsumerConfig("local", "g2", ("t",))), catch_up_seconds=600)
    assert timed.wait(timed.load_async(snapshot)).progress == (Progress("t", 0, n, n),)
    assert [k for _, k, _ in polls] == [700, 1_400, 900] and seen(timed.visible()) == want


def test_batches_apply_whole_or_not_at_all(spark, tmp_path):
    index = LayeredIndex(spark, f"{tmp_path}/w", 2, 7, mode=Mode.FULL_WITH_REALTIME)
    with pytest.raises(FailedPrecondition):
        index.apply(messages(spark, [(0, 1, 1, {"score": 1})]))
    index.open_realtime(S, 2)
    index.apply(messages(spark, [(0, 5, 104, {"score": 5})]))
    index.apply(messages(spark, [(0, 4, 104, {"score": 4}), (0, 5, 104, {"score": 55})]))  # stale, idempotent
    assert index.get(104).score == 5 and index.stats().published_rows == 3 and index.stats().unique_keys == 1
    bad = messages(spark, [(0, 6, 105, {"score": 6})]).unionByName(messages(spark, [(0, 7, 106, None)]).withColumn("seq", F.lit(1).cast("long")))
    with pytest.raises(InvalidArgument):
        index.apply(bad)
    with pytest.raises(FailedPrecondition):
        index.apply(messages(spark, [(1, 6, 104, {"score": 6})]))
    with pytest.raises(FailedPrecondition):
        index.apply(messages(spark, [(0, 10 + k, k, {"score": k}) for k in range(20)]))  # over capacity
    assert seen(index.visible()) == {104: (5, None)}


def test_batches_count_their_new_keys_only(spark, tmp_path):
    """The keys of every shard after each batch; the log's keys meet the batch's where they are."""
    index = LayeredIndex(spark, f"{tmp_path}/w", 4, 7, mode=Mode.FULL_WITH_REALTIME)
    index.open_realtime(S, 30)
    for k, keys in enumerate(([1, 2, 3], [3, 4, 4], [1], [200, 201, 2])):
        index.apply(messages(spark, [(0, 10 * k + i, x, {"score": k}) for i, x in enumerate(keys)]))
        live = index.log(index.directory()[0].realtime).groupBy("shard_id").agg(F.count_distinct("pk").alias("n")).collect()
        assert {s.shard_id: s.realtime.stats.unique_keys for s in index.directory()} == {k: 0 for k in range(4)} | {r.shard_id: r.n for r in live}
    batch = spark.createDataFrame([(0, 9, 0)], "shard_id int, pk long, partition int")
    plan = index._met(batch, index.directory())._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin [shard_id" in plan and "LeftSemi, BuildRight" in plan


def together(*calls):
    from concurrent.futures import ThreadPoolExecutor

    with ThreadPoolExecutor(len(calls)) as pool:
        for f in [pool.submit(c) for c in calls]:
            f.result()


def test_concurrent_batches_are_all_kept(spark, tmp_path):
    index = LayeredIndex(spark, f"{tmp_path}/w", 2, 7, mode=Mode.FULL_WITH_REALTIME_AND_COMPACTION)
    index.open_realtime(S, 100)
    batch = lambda k: messages(spark, [(0, 10 * k + i, 10 * k + i, {"score": k}) for i in range(3)])
    together(*[lambda k=k: index.apply(batch(k)) for k in range(1, 5)])
    want = {10 * k + i: (k, None) for k in range(1, 5) for i in range(3)}
    assert seen(index.visible()) == want and index.stats().unique_keys == 12 and index.stats().published_rows == 12
    together(index.compact, *[lambda k=k: index.apply(batch(k)) for k in range(5, 8)])
    want |= {10 * k + i: (k, None) for k in range(5, 8) for i in range(3)}
    assert seen(index.visible()) == want
    left = index.log(index.directory()[0].realtime).select("pk").distinct().count()
    assert index.stats().unique_keys == left
    with pytest.raises(FailedPrecondition):
        index.rebase()  # no full layer
    base = index.directory()
    index.apply(batch(9))
    with pytest.raises(Changed):
        index.publish(*base, base=base)


def test_compaction_leaves_later_batches_and_their_statistics(spark, tmp_path, monkeypatch):
    index = LayeredIndex(spark, f"{tmp_path}/w", 2, 7, mode=Mode.FULL_WITH_REALTIME_AND_COMPACTION)
    index.open_realtime(S, 100)
    index.apply(messages(spark, [(0, 1, 1, {"score": 1})]))
    real = index._written

    def slow(*args):
        out = real(*args)
        index.apply(messages(spark, [(0, 5, 2, {"score": 2}), (0, 6, 3, {"score": 3})]))  # arrives meanwhile
        return out

    monkeypatch.setattr(index, "_written", slow)
    index.compact()
    assert seen(index.visible()) == {1: (1, None), 2: (2, None), 3: (3, None)}
    assert (index.stats().unique_keys, index.stats().published_rows) == (2, 2)


def test_reopened_index_serves_what_was_published(spark, tmp_path, snapshot):
    log = f"{tmp_path}/log"
    messages(spark, [(0, 0, 3, {"score": 1})]).select("topic", "partition", "offset", F.col("pk").cast("string").alias("key"), "payload").write.parquet(log)
    index = LayeredIndex(spark, f"{tmp_path}/w", 2, 7, consumer=lambda: LogConsumer(spark, log, ConsumerConfig("local", "g", ("t",))))
    assert index.wait(index.load_async(snapshot)).code is LoadCode.SUCCEEDED
    index.compact()
    index.apply(messages(spark, [(0, 7, 4, {"score": 9})]))
    again = LayeredIndex.reopen(spark, f"{tmp_path}/w")
    assert again.directory() == index.directory() and seen(again.visible()) == seen(index.visible())
    again.apply(messages(spark, [(0, 8, 5, {"score": 8})]))
    assert again.get(5).score == 8 and again.get(4).score == 9 and again.stats().unique_keys == 2
    with pytest.raises(NotFound):
        LayeredIndex.reopen(spark, f"{tmp_path}/nowhere")


def test_rebase_refuses_other_hash_settings(spark, tmp_path, snapshot):
    index = LayeredIndex(spark, f"{tmp_path}/w", 2, 7, mode=Mode.FULL_ONLY)
    index.wait(index.load_async(snapshot))
    now = index.directory()
    index.publish(*[replace(s, compact=replace(s.full, settings=maintain.HashSettings(2, 8, 1))) for s in now])
    with pytest.raises(FailedPrecondition, match="hash settings"):
        index.rebase()


def test_strict_reading_of_odd_files(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    s = Schema.of(1, Field(1, "score", "int32", nullable=False, default=4))
    one = pa.table({"id": pa.array([1], pa.int64()), "score": pa.array([10], pa.int32())})
    for folder in ("hidden/_x", "hidden/a"):
        (tmp_path / folder).mkdir(parents=True)
    pq.write_table(one, tmp_path / "hidden/a/f.parquet")
    pq.write_table(one.set_column(0, "id", pa.array([2], pa.int64())), tmp_path / "hidden/_x/f.parquet")
    assert seen(parquet_rows.read_rows(spark, f"{tmp_path}/hidden", s, "id")) == {1: (10,), 2: (10,)}
    for kind in (pa.uint8(), pa.uint16(), pa.uint32(), pa.int16()):
        (tmp_path / str(kind)).mkdir()
        pq.write_table(one.set_column(1, "score", pa.array([10], kind)), tmp_path / str(kind) / "f.parquet")
        with pytest.raises(InvalidArgument):
            parquet_rows.read_rows(spark, f"{tmp_path}/{kind}", s, "id")
    (tmp_path / "absent").mkdir()
    pq.write_table(one, tmp_path / "absent/f.parquet")
    pq.write_table(pa.table({"id": pa.array([5], pa.int64())}), tmp_path / "absent/g.parquet")
    assert seen(parquet_rows.read_rows(spark, f"{tmp_path}/absent", s, "id")) == {1: (10,), 5: (None,)}  # the default applies
    pq.write_table(pa.table({"id": pa.array([6], pa.int64()), "score": pa.array([None], pa.int32())}), tmp_path / "absent/h.parquet")
    with pytest.raises(InvalidArgument):
        parquet_rows.read_rows(spark, f"{tmp_path}/absent", s, "id")
    with pytest.raises(InvalidArgument):
        parquet_rows.read_rows(spark, f"{tmp_path}/absent", Schema.of(1, Field(1, "score", "int32", nullable=False)), "id")


def test_keys_are_digits_only(spark):
    texts = ["42", "42\n", "\n42", "042", "0", "000", "", " 1", "18446744073709551615", "00018446744073709551615", "18446744073709551616", "1" * 60, "0" * 60 + "7", "٣", None]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", positions.parse_key(F.col("t")).alias("k")).collect()
    want = {t: int(t) if t and t.isascii() and t.isdigit() and int(t) < 2**64 else None for t in texts}
    assert {r.t: None if r.k is None else int(r.k) for r in got} == want


def test_polls_of_sparse_and_repeated_offsets(spark, tmp_path):
    path, far = f"{tmp_path}/log", 1 << 50
    offsets = {0: [3, 4, 4, 9, 40, far, far + 1], 1: [0, 1], 2: [7, 7, 7]}
    rows = [("t", p, o, str(o), bytearray(wire.encode_row(S, {"score": 1}))) for p, some in offsets.items() for o in some]
    spark.createDataFrame(rows, update_log.MESSAGE).write.parquet(path)
    for most in (2, 100):
        c, got = LogConsumer(spark, path, ConsumerConfig("local", f"g{most}", ("t",))), []
        while (batch := c.poll(most)) is not None:
            some = batch.select("partition", "offset", "seq").collect()
            updates.validate(batch.withColumn("row", F.lit(1)))
            for p in offsets:
                own = sorted((r.seq, r.offset) for r in some if r.partition == p)
                assert len({o for _, o in own}) <= most and [o for _, o in own] == sorted(o for _, o in own)
            got += [(r.partition, r.offset) for r in some]
        assert sorted(got) == sorted((p, o) for p, some in offsets.items() for o in some)
        assert c.next == {("t", 0): far + 2, ("t", 1): 2, ("t", 2): 8}


def test_consumer(spark, tmp_path):
    path, config = f"{tmp_path}/log", ConsumerConfig("local", "g", ("t",))
    rows = [("t", p, o, str(100 + o), bytearray(wire.encode_row(S, {"score": o}))) for p, o in ((0, 10), (1, 7), (0, 12))]
    spark.createDataFrame(rows, update_log.MESSAGE).write.parquet(path)
    index = LayeredIndex(spark, f"{tmp_path}/w", 2, 7, mode=Mode.FULL_WITH_REALTIME)
    index.open_realtime(S, 100)
    c = LogConsumer(spark, path, config)
    assert index.poll_apply_commit(c) == 2 and c.committed() == {("t", 0): 13, ("t", 1): 8}
    began = time.monotonic()
    assert index.poll_apply_commit(c) == 0
    assert c.poll(5, 400) is None and time.monotonic() - began >= 0.4  # waits, then gives up
    late = threading.Timer(0.3, lambda: spark.createDataFrame([("t", 1, 9, "5", bytearray(wire.encode_row(S, {"score": 1})))], update_log.MESSAGE).write.mode("append").parquet(path))
    late.start()
    assert c.poll(5, 20_000).count() == 1  # came meanwhile
    late.join()
    c.seek({("t", 0): 13, ("t", 1): 10})
    c.commit({("t", 1): 10})
    kafka = spark.createDataFrame([(bytearray(b"7"), bytearray(b"x"), "t", 0, 3, 1)], "key binary, value binary, topic string, partition int, offset long, timestampType int")
    assert update_log.from_kafka(kafka).schema.simpleString() == spark.createDataFrame([], update_log.MESSAGE).schema.simpleString() and update_log.from_kafka(kafka).first().key == "7"
    assert c.progress() == [Progress("t", 0, 13, 13), Progress("t", 1, 10, 10)]
    for bad in (lambda: c.poll(0), lambda: c.poll(1, -1), lambda: c.seek({("u", 0): 1}), lambda: c.seek({("t", 0): -1}), lambda: ConsumerConfig("", "g", ("t",)), lambda: ConsumerConfig("s", "g", ("t", "t"))):
        with pytest.raises(InvalidArgument):
            bad()
    with pytest.raises(FailedPrecondition):
        update_log.merged_progress([], [])
    assert update_log.merged_progress([Progress("t", 0, 0, 9)], [Progress("t", 0, 3, 5)]) == [Progress("t", 0, 3, 9)]
    assert "earliest" in update_log.kafka_options(config).values()


def test_stream_equals_batch_and_replays_change_nothing(spark, tmp_path):
    rows = [("t", 0, o, str(o % 5), bytearray(wire.encode_row(S, {"score": o}))) for o in range(40)]
    spark.createDataFrame(rows[:20], update_log.MESSAGE).coalesce(1).write.parquet(f"{tmp_path}/m")
    targets = []
    for k in range(2):
        targets.append(LayeredIndex(spark, f"{tmp_path}/w{k}", 2, 7, mode=Mode.FULL_WITH_REALTIME))
        targets[-1].open_realtime(S, 100)
    run = lambda check: upserts.ingest(upserts.messages(spark, f"{tmp_path}/m", 1), targets, f"{tmp_path}/{check}").awaitTermination()
    run("c")
    spark.createDataFrame(rows[20:], update_log.MESSAGE).coalesce(1).write.mode("append").parquet(f"{tmp_path}/m")
    run("c")
    want = {k: (35 + k, None) for k in range(5)}
    assert [seen(t.visible()) for t in targets] == [want, want]
    run("again")  # a new checkpoint: everything is replayed
    assert seen(targets[0].visible()) == want


def test_keyed_state_in_a_stream(spark, tmp_path):
    kind = "pk long, partition int, offset long, seq long"
    spark.createDataFrame([(1, 0, 5, 1), (1, 0, 4, 2), (1, 0, 5, 3), (1, 1, 9, 4), (2, 0, 1, 5)], kind).coalesce(1).write.parquet(f"{tmp_path}/m")
    stream = spark.readStream.schema(kind).parquet(f"{tmp_path}/m")
    q = upserts.decisions(stream).writeStream.format("memory").queryName("decided").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    got = [(r.pk, r.offset, r.decision) for r in spark.table("decided").collect()]
    assert sorted(got) == [(1, 4, "stale"), (1, 5, "idempotent"), (1, 5, "newer"), (1, 9, "conflict"), (2, 1, "newer")]


def test_command_line(spark, tmp_path, capsys):
    from layerkeep import cli

    layer(spark, FULL).select("pk", "row.*").write.parquet(f"{tmp_path}/in")
    (tmp_path / "s.yaml").write_text(schema_file.format_schema(schema_file.SchemaFile(S, "pk", 4)))
    args = ["--schema", f"{tmp_path}/s.yaml", "--input", f"{tmp_path}/in", "--output", f"{tmp_path}/out", "--progress", "t:0:5:8", "--hash-seed", "3"]
    assert cli.main(args) == 0 and "rows 3" in capsys.readouterr().out
    assert cli.main(args) == 1
    assert Artifact.open(spark, f"{tmp_path}/out").manifest.hash_seed == 3
