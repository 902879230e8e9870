"""Command line: build an artifact from Parquet files and a schema file."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .errors import LayerError
from .sources.artifact import Progress
from .sources.builder import BuildOptions, build


def progress(text: str) -> Progress:
    topic, partition, next_offset, high = text.rsplit(":", 3)
    return Progress(topic, int(partition), int(next_offset), int(high))


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="python -m layerkeep.cli", description=__doc__)
    p.add_argument("--schema", required=True)
    p.add_argument("--input", required=True)
    p.add_argument("--output", required=True)
    p.add_argument("--artifact-id", default="")
    for name in ("shard-count", "hash-seed", "hash-version", "output-schema-version"):
        p.add_argument(f"--{name}", type=int)
    p.add_argument("--progress", action="append", type=progress, metavar="TOPIC:PARTITION:NEXT:HIGH", help="source progress; may repeat")
    p.add_argument("--empty-progress", action="store_true", help="record that there is no source progress instead of leaving it out")
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("layerkeep-build").getOrCreate()
    given = tuple(a.progress) if a.progress else () if a.empty_progress else None
    try:
        made = build(spark, BuildOptions(a.schema, a.input, a.output, a.artifact_id, a.shard_count, a.hash_seed, a.hash_version, a.output_schema_version, given))
    except LayerError as e:
        print(f"{e.code.value}: {e}", file=sys.stderr)
        return 1
    print(f"files {made.input_files} rows {made.rows} shards {made.manifest.shard_count} schema {made.manifest.schema.version}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
