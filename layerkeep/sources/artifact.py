"""Artifacts: immutable snapshots as Parquet by shard, with a checked manifest.

An artifact is a folder with ``manifest.json`` and ``rows/shard_id=N/``. Rows lie
sorted by key within a shard, so a point lookup reads one folder and, by the
files' statistics, few row groups. The manifest holds the schema with defaults
and deleted fields, hash settings, rows and a checksum for each shard (a sum of
row hashes, computed by Spark), and the source progress if there is one.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import FailedPrecondition, InvalidArgument, NotFound
from ..functions.hashing import check_shard_count, with_shard
from ..operators.overlay import duplicate_keys
from ..schema import Schema
from .files import Files, check_uri

FORMAT, FORMAT_VERSION = "layerkeep-artifact", 1


@dataclass(frozen=True)
class Progress:
    """How far a partition was consumed when the snapshot was taken."""

    topic: str
    partition: int
    next_offset: int
    high_watermark: int


@dataclass(frozen=True)
class Manifest:
    artifact_id: str
    schema: Schema
    shard_count: int
    hash_seed: int
    hash_version: int
    rows: dict[int, int]
    checksums: dict[int, str]
    progress: tuple[Progress, ...] | None = None
    fingerprint: int = field(default=0)

    def to_json(self) -> str:
        body = {
            "format": FORMAT, "format_version": FORMAT_VERSION, "artifact_id": self.artifact_id, "schema": json.loads(self.schema.to_json()),
            "fingerprint": str(self.schema.layout().fingerprint), "shard_count": self.shard_count, "hash_seed": str(self.hash_seed), "hash_version": self.hash_version,
            "rows": {str(k): v for k, v in self.rows.items()}, "checksums": {str(k): v for k, v in self.checksums.items()},
            "progress": None if self.progress is None else [asdict(p) for p in self.progress],
        }
        text = json.dumps(body, sort_keys=True, indent=1)
        return json.dumps({"manifest": body, "sha256": hashlib.sha256(text.encode()).hexdigest()}, sort_keys=True, indent=1)


def check_progress(progress: tuple[Progress, ...]) -> None:
    seen = set()
    for p in progress:
        if not p.topic or p.partition < 0 or p.next_offset < 0 or p.high_watermark < 0:
            raise InvalidArgument("source progress is malformed")
        if (p.topic, p.partition) in seen:
            raise InvalidArgument("source progress names a partition twice")
        seen.add((p.topic, p.partition))


def parse_manifest(text: str, *, shard_count: int | None = None, hash_seed: int | None = None, hash_version: int | None = None, progress_optional: bool = True) -> Manifest:
    """The manifest, after all checks that need no rows. Settings that are given must agree."""
    try:
        outer = json.loads(text)
        m = outer["manifest"]
        good = hashlib.sha256(json.dumps(m, sort_keys=True, indent=1).encode()).hexdigest() == outer["sha256"]
        if m["format"] != FORMAT or m["format_version"] != FORMAT_VERSION:
            raise InvalidArgument(f"unknown format {m['format']} {m['format_version']}")
        if not good:
            raise FailedPrecondition("the manifest's checksum is wrong")
        schema = Schema.from_json(m["schema"])
        progress = None if m["progress"] is None else tuple(Progress(**p) for p in m["progress"])
        out = Manifest(
            m["artifact_id"], schema, m["shard_count"], int(m["hash_seed"]), m["hash_version"],
            {int(k): v for k, v in m["rows"].items()}, {int(k): v for k, v in m["checksums"].items()}, progress, int(m["fingerprint"]),
        )
    except (KeyError, TypeError, json.JSONDecodeError) as e:
        raise InvalidArgument(f"the manifest is malformed: {e}") from e
    check_shard_count(out.shard_count)
    if out.fingerprint != schema.layout().fingerprint:
        raise FailedPrecondition("the schema's fingerprint is wrong")
    if set(out.rows) != set(range(out.shard_count)) or set(out.checksums) != set(out.rows):
        raise InvalidArgument("the manifest's shards are incomplete")
    if progress is None and not progress_optional:
        raise InvalidArgument("source progress is missing")
    if progress is not None:
        check_progress(progress)
    for what, want, got in (("shard count", shard_count, out.shard_count), ("hash seed", hash_seed, out.hash_seed), ("hash version", hash_version, out.hash_version)):
        if want is not None and want != got:
            raise FailedPrecondition(f"{what} is {got}, expected {want}")
    return out


def misplaced_keys(rows: DataFrame, shard_count: int, hash_seed: int = 0, hash_version: int = 1) -> DataFrame:
    """shard_id, pk, own_shard of the rows (shard_id, pk) that lie in another shard than their key's."""
    dealt = with_shard(rows.select("shard_id", "pk"), shard_count, out="own_shard", seed=hash_seed, version=hash_version)
    return dealt.filter("shard_id <> own_shard").select("shard_id", "pk", "own_shard")


def shard_sums(rows: DataFrame) -> DataFrame:
    """shard_id, n, checksum of (shard_id, pk, row)."""
    return rows.groupBy("shard_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("pk", "row").cast("decimal(20,0)")).cast("string").alias("checksum"))


def write_artifact(
    rows: DataFrame, path: str, schema: Schema, artifact_id: str, shard_count: int = 128, hash_seed: int = 0, hash_version: int = 1,
    progress: tuple[Progress, ...] | None = None, shard: int | None = None, bloom: bool = False,
) -> Manifest:
    """Writes (pk, row) as an artifact; all shards, or one of them. ``bloom`` adds a filter of keys to every row group, for lookups of keys that are mostly missing."""
    spark, files = rows.sparkSession, Files(rows.sparkSession)
    if files.exists(f"{path}/manifest.json"):
        raise FailedPrecondition(f"{path} holds an artifact; artifacts are immutable")
    if progress is not None:
        check_progress(progress)
    dealt = with_shard(rows.select("pk", "row"), shard_count, seed=hash_seed, version=hash_version)
    if shard is not None:
        dealt = dealt.filter(F.col("shard_id") == shard)
    # Ranges of (shard, key): a shard that is larger than others is spread over several tasks and files.
    laid = dealt.repartitionByRange("shard_id", "pk").sortWithinPartitions("shard_id", "pk")
    writer = laid.write.partitionBy("shard_id").option("parquet.bloom.filter.enabled#pk", str(bloom).lower())
    writer.parquet(f"{path}/rows")
    seen = {r.shard_id: r for r in shard_sums(read_shards(spark, path, schema)).collect()}  # one row for each shard
    shards = range(shard_count)
    made = Manifest(
        artifact_id, schema, shard_count, hash_seed, hash_version, {k: seen[k].n if k in seen else 0 for k in shards},
        {k: seen[k].checksum if k in seen else "0" for k in shards}, progress, schema.layout().fingerprint,
    )
    files.write_text(f"{path}/manifest.json", made.to_json())
    return made


def read_shards(spark: SparkSession, path: str, schema: Schema, shards: list[int] | None = None) -> DataFrame:
    """(shard_id, pk, row); a list of shards prunes folders."""
    from pyspark.sql import types as T

    kind = T.StructType([T.StructField("pk", T.LongType()), T.StructField("row", schema.row_type()), T.StructField("shard_id", T.IntegerType())])
    df = spark.read.schema(kind).option("basePath", f"{path}/rows").parquet(f"{path}/rows").select("shard_id", "pk", "row")
    return df if shards is None else df.filter(F.col("shard_id").isin([int(s) for s in shards]))


@dataclass(frozen=True)
class Artifact:
    """An opened artifact. Its rows are read from its own folder, whatever is published later."""

    path: str
    manifest: Manifest

    @classmethod
    def open(cls, spark: SparkSession, uri: str, schemes: tuple[str, ...] = ("file",), **expected) -> Artifact:
        path = check_uri(uri, schemes)
        files = Files(spark)
        if not files.exists(f"{path}/manifest.json"):
            raise NotFound(f"{path} holds no artifact")
        return cls(path, parse_manifest(files.read_text(f"{path}/manifest.json"), **expected))

    def rows(self, spark: SparkSession, shards: list[int] | None = None) -> DataFrame:
        return read_shards(spark, self.path, self.manifest.schema, shards)

    def verify(self, spark: SparkSession, shards: list[int] | None = None) -> None:
        """Compares rows and checksums with the manifest, in one aggregation."""
        seen = {r.shard_id: (r.n, r.checksum) for r in shard_sums(self.rows(spark, shards)).collect()}
        for k in shards if shards is not None else range(self.manifest.shard_count):
            if seen.get(k, (0, "0")) != (self.manifest.rows[k], self.manifest.checksums[k]):
                raise FailedPrecondition(f"shard {k} differs from its manifest")

    def check_keys(self, spark: SparkSession) -> None:
        """Raises if a key lies in another shard than its hash says, or occurs twice; needs a shuffle by key."""
        m = self.manifest
        rows = self.rows(spark)
        if wrong := misplaced_keys(rows, m.shard_count, m.hash_seed, m.hash_version).first():
            raise FailedPrecondition(f"a key of shard {wrong.own_shard} lies in shard {wrong.shard_id}")
        if again := duplicate_keys(rows).first():
            raise FailedPrecondition(f"key {again.pk & (2**64 - 1)} occurs {again.n} times")
