"""Strict reading of Parquet files as keyed rows.

Types must be exactly the schema's: nothing is widened. A column that is
missing is absent if its field is nullable, else an error; so is a null in a
required field, a null in a list, and a key that is null or negative. Other
columns are ignored. Folders named like partitions add no columns.
"""

from __future__ import annotations

import re
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import FailedPrecondition, InvalidArgument, NotFound
from ..functions.hashing import key_bits
from ..operators.overlay import duplicate_keys
from ..schema import Schema
from .files import Files

UNSIGNED = T.DecimalType(20, 0)


def parquet_files(spark: SparkSession, path: str) -> list[str]:
    """The Parquet files at a path, children in order of name; names that begin with a dot are skipped."""
    files = Files(spark)
    if not files.exists(path):
        raise NotFound(f"{path} is missing")
    if not files.is_dir(path):
        if not path.endswith(".parquet"):
            raise NotFound(f"{path} is no Parquet file")
        return [path]
    out, todo = [], [path]
    while todo:
        here = todo.pop()
        for child, is_dir in files.children(here):
            if child.rsplit("/", 1)[-1].startswith("."):
                continue
            if is_dir:
                todo.append(child)
            elif child.endswith(".parquet"):
                out.append(child)
    if not out:
        raise NotFound(f"{path} holds no Parquet files")
    return sorted(out)


def _same(a: T.DataType, b: T.DataType) -> bool:
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return _same(a.elementType, b.elementType)
    return a == b


#: How a path may begin: ``file:/x`` and ``file:///x`` are one.
SCHEME = "^[A-Za-z][A-Za-z0-9+.-]*:/+"
#: Parquet's annotations that Spark reads as a wider signed type.
WIDENED = {"INTEGER(8,false)": "uint8", "INTEGER(16,false)": "uint16", "INTEGER(32,false)": "uint32"}


def footers(spark: SparkSession, files: list[str]) -> dict[str, dict[str, str]]:
    """For each file the top-level columns with their Parquet types as text; only footers are read, several at a time."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def one(path: str) -> dict[str, str]:
        at = jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(path), conf)
        reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(at)
        try:
            return {f.getName(): f.toString() for f in reader.getFileMetaData().getSchema().getFields()}
        finally:
            reader.close()

    with ThreadPoolExecutor(16) as pool:
        return dict(zip(files, pool.map(one, files), strict=True))


def _file_checks(found: dict[str, dict[str, str]], schema: Schema) -> dict[str, list[str]]:
    """Raises for a type that is not exactly a field's, and for a file without a required column; the files that lack one which has a default."""
    absent: dict[str, list[str]] = {}
    for path, columns in found.items():
        for f in schema.fields:
            if f.name not in columns:
                if not f.nullable and f.default is None:
                    raise InvalidArgument(f"{path} lacks the required column {f.name}")
                absent.setdefault(f.name, []).append(path)
            else:
                for mark, kind in WIDENED.items():
                    if mark in columns[f.name]:
                        raise InvalidArgument(f"column {f.name} of {path} is {kind}, not {f.type}")
    return absent


def _resolved(df: DataFrame, schema: Schema, key: str, absent: dict[str, list[str]]) -> tuple[DataFrame, list]:
    """(pk, row) from columns by name, and the checks to run: (whether a row is bad, message).

    A null in a required column with a default is no fault in the files of
    ``absent``, which lack the column.
    """
    columns = {f.name: f.dataType for f in df.schema.fields}
    if key not in columns:
        raise InvalidArgument(f"the key column {key} is missing")
    if columns[key] not in (T.LongType(), UNSIGNED):
        raise InvalidArgument(f"the key column {key} is {columns[key].simpleString()}, neither int64 nor uint64")
    parts, checks = [], [(F.col(key).isNull() | (F.col(key) < 0), f"the key column {key} holds null or a negative number")]
    for f in schema.fields:
        if f.name not in columns:
            if not f.nullable and f.default is None:
                raise InvalidArgument(f"the required column {f.name} is missing")
            parts.append(F.lit(None).cast(f.spark_type).alias(f.name))
            continue
        if not _same(columns[f.name], f.spark_type):
            raise InvalidArgument(f"column {f.name} is {columns[f.name].simpleString()}, not {f.spark_type.simpleString()}")
        x = F.col(f.name)
        if not f.nullable:
            here = F.regexp_replace(F.input_file_name(), SCHEME, "/")
            lacking = here.isin([re.sub(SCHEME, "/", p) for p in absent[f.name]]) if f.name in absent else F.lit(False)
            checks.append((x.isNull() & ~lacking, f"the required column {f.name} holds null"))
        if f.is_list:
            checks.append((F.exists(x, lambda e: e.isNull()), f"the list column {f.name} holds a null element"))
        parts.append(x.alias(f.name))
    return df.select(key_bits(F.col(key)).alias("pk"), F.struct(*parts).alias("row")), checks


def merged(spark: SparkSession, path: str, files: list[str]) -> DataFrame:
    """All files below a path under the union of their columns; a column of two types is an error.

    Spark reads the footers in parallel and merges their schemas; a column that
    a file lacks is null in its rows.
    """
    reader = spark.read.option("mergeSchema", "true")
    try:
        if any("/_" in f for f in files):  # names that Spark would skip
            return reader.parquet(*files)
        return reader.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(path)
    except Exception as e:
        if "MERGE_SCHEMAS" in str(e):
            raise InvalidArgument(f"files disagree on a column's type: {str(e)[:300]}") from e
        raise


def read_rows(spark: SparkSession, path: str, schema: Schema, key: str, check: bool = True) -> DataFrame:
    """(pk as bit pattern, row) of all files below a path.

    The checks are one aggregation and one search for repeated keys, run before
    anything is returned.
    """
    schema.row_type()
    files = parquet_files(spark, path)
    df = merged(spark, path, files)
    rows, checks = _resolved(df, schema, key, _file_checks(footers(spark, files), schema))
    if check:
        seen = df.select(*[c.alias(f"c{i}") for i, (c, _) in enumerate(checks)])
        bad = seen.agg(*[F.coalesce(F.bool_or(c), F.lit(False)).alias(c) for c in seen.columns]).first()
        for i, (_, message) in enumerate(checks):
            if bad[f"c{i}"]:
                raise InvalidArgument(message)
        if again := duplicate_keys(rows).first():
            raise FailedPrecondition(f"key {again.pk & (2**64 - 1)} occurs {again.n} times")
    return rows
