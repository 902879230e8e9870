"""Building an artifact from Parquet files and a schema file, as one distributed job."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession

from ..errors import InvalidArgument
from ..functions.hashing import check_shard_count
from . import schema_file
from .artifact import Manifest, Progress, write_artifact
from .parquet_rows import parquet_files, read_rows


@dataclass(frozen=True)
class BuildOptions:
    """What is None comes from the schema file, or else from the fixed values 128, 0 and 1; the version is one above the file's."""

    schema_path: str
    input_path: str
    output_path: str
    artifact_id: str = ""
    shard_count: int | None = None
    hash_seed: int | None = None
    hash_version: int | None = None
    output_schema_version: int | None = None
    progress: tuple[Progress, ...] | None = None


@dataclass(frozen=True)
class BuildResult:
    manifest: Manifest
    input_files: int
    rows: int
    rows_by_shard: dict[int, int]


def build(spark: SparkSession, options: BuildOptions) -> BuildResult:
    if not options.schema_path or not options.input_path or not options.output_path:
        raise InvalidArgument("schema, input and output paths are needed")
    from dataclasses import replace

    file = schema_file.read(spark, options.schema_path)
    pick = lambda given, own, fixed: given if given is not None else own if own is not None else fixed
    shards = check_shard_count(pick(options.shard_count, file.shard_count, 128))
    seed, hash_version = pick(options.hash_seed, file.hash_seed, 0), pick(options.hash_version, file.hash_version, 1)
    version = pick(options.output_schema_version, None, file.schema.version + 1)
    schema = replace(file.schema, version=version)
    files = parquet_files(spark, options.input_path)
    rows = read_rows(spark, options.input_path, schema, file.primary_key)
    made = write_artifact(rows, options.output_path, schema, options.artifact_id, shards, seed, hash_version, options.progress)
    schema_file.write(spark, f"{options.output_path}/schema.yaml", file, version)
    return BuildResult(made, len(files), sum(made.rows.values()), made.rows)
