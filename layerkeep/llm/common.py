"""Helpers shared by the operators: reading tables, shared scratch space, folding of rows into Arrow."""

from __future__ import annotations

import ctypes
import gc
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that part words: space, tab, line feed, vertical tab, form feed, carriage return.
WHITE = " \t\n\x0b\f\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A folder that the driver and all executors see.

    It is the cluster's ``spark.checkpoint.dir``. Only where that is unset and
    Spark runs on one machine, as in tests, a temporary folder is made and set.
    """
    held = spark.conf.get("spark.checkpoint.dir", None)
    if held:
        return held.rstrip("/")
    made = spark.sparkContext.getCheckpointDir()
    if not made:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("a cluster needs spark.checkpoint.dir, a folder that all its machines share")
        spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='layerkeep-')}")
        made = spark.sparkContext.getCheckpointDir()
    return made.rstrip("/")


def written(df: DataFrame, what: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/layerkeep/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _scratch.append((path, None))
    return spark.read.schema(df.schema).parquet(path)


#: Folders, and the tables over them, that this process has written.
_scratch: list[tuple[str, str | None]] = []


def scratch_mark() -> int:
    """How much scratch there is; what is made from now on can be deleted by ``delete_scratch``."""
    return len(_scratch)


def noted(path: str, name: str) -> None:
    """Counts a table as scratch."""
    _scratch.append((path, name))


def delete_scratch(spark: SparkSession, since: int = 0, but: DataFrame | None = None) -> None:
    """Deletes the scratch made after a mark, but for the files that ``but`` reads. Results that still read it are lost."""
    kept = set() if but is None else {f.rsplit("/", 1)[0].rsplit(":", 1)[-1].lstrip("/") for f in but.inputFiles()}
    for path, name in _scratch[since:]:
        if path.rsplit(":", 1)[-1].lstrip("/") in kept:
            continue
        if name:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    _scratch[since:] = [x for x in _scratch[since:] if x[0].rsplit(":", 1)[-1].lstrip("/") in kept]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Rows of one Arrow batch at most: texts may be long, and a batch is held by Spark and by Python.
BATCH_ROWS = 1_500


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's rows of an Arrow batch to ``BATCH_ROWS``, unless it asks for fewer."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    held = int(spark.conf.get(name))
    if held <= 0 or held > BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def id_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The two columns that an operator reads, whatever else the table has."""
    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def remainder(id_column: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; a null id counts as empty text."""
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")) % n


def rows_of(batch: pa.RecordBatch, most_chars: int = 8_000_000) -> Iterator[tuple[pa.Array, list[str | None]]]:
    """(ids, texts) of a batch in runs of bounded size; a text is never split."""
    ids, texts = batch.column(0), batch.column(1)
    held: list[str | None] = []
    start = size = 0
    for i, x in enumerate(texts):
        x = x.as_py()
        held.append(x)
        size += len(x or "")
        if size >= most_chars:
            yield ids.slice(start, len(held)), held
            held, start, size = [], i + 1, 0
    if held:
        yield ids.slice(start, len(held)), held


def least_hashes(order: Column, wanted: int, rows: int) -> Column:
    """Whether a 64-bit hash is small enough to be among the ``wanted`` least of ``rows``.

    Lets half as many again and 200 more pass, which the least ones are among
    but with a chance far below that of a hash collision; so the exact choice
    has a bounded number of rows to rank, whatever the input.
    """
    share = min(1.0, (1.5 * wanted + 200) / max(1, rows))
    return F.lit(True) if share >= 1 else order <= F.lit(int(-(2**63) + share * 2**64))


def tidy() -> None:
    """Gives memory that is free back to the system; idle Python workers would hold it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        libc = ctypes.CDLL(None)
        libc.mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD: arrays go back at once when they are freed
        libc.malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def leaving_tidy(run: Callable) -> Callable:
    """A function over batches that gives its memory back when a task ends."""

    def wrapped(batches):
        tidy()
        try:
            yield from run(batches)
        finally:
            tidy()

    return wrapped


def forget() -> None:
    """Drops what earlier tasks of this Python worker left; operators that keep nothing call it first."""
    if sys.__dict__.pop("_layerkeep_kept", None):
        tidy()


def cached(key: str, make: Callable):
    """A value kept for the life of a Python worker, one at a time."""
    held = sys.__dict__.get("_layerkeep_kept", {})
    if key not in held:
        forget()
        held = {key: make()}
        sys.__dict__["_layerkeep_kept"] = held
    return held[key]


#: A key is hot from this share of all rows on, so at most 1 / HOT_SHARE keys are hot, whatever the input.
HOT_SHARE = 0.001


def join_small_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``groups`` (one row for each key, with the number of rows it has in all).

    Rows of hot keys meet a broadcast of at most 1 / HOT_SHARE groups where they
    are; only the others are shuffled, so no task gets a hot key's rows.
    ``how``: inner or left_semi.
    """
    hot = F.col(size) > max(2, int(total * HOT_SHARE))
    few, many = groups.filter(hot), groups.filter(~hot)
    if how == "left_semi":
        few, many = few.select(*keys), many.select(*keys)
    rest = rows.join(F.broadcast(few.select(*keys)), keys, "left_anti")
    return rows.join(F.broadcast(few), keys, how).unionByName(rest.join(many, keys, how))


#: Ids broadcast at most, counted first; beyond, the join shuffles.
MOST_BROADCAST = 1_000_000


def without(docs: DataFrame, gone: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows, with all their columns, whose id is not in ``gone`` (one column); rows without an id stay."""
    ids = written(gone.toDF("__gone").filter("__gone is not null").distinct(), "gone")
    side = F.broadcast(ids) if ids.count() <= MOST_BROADCAST else ids
    return docs.join(side, F.col(id_col) == F.col("__gone"), "left_anti")


def one_row_each(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row for each id. Where no id repeats, the rows are as they were and nothing is shuffled but ids."""
    again = written(docs.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__again")).count().filter("count > 1").select("__again"), "repeated")
    n = again.count()
    if not n:
        return docs
    side = F.broadcast(again) if n <= MOST_BROADCAST else again
    match = F.col(id_col) == F.col("__again")
    return docs.join(side, match, "left_anti").unionByName(docs.join(side, match, "left_semi").dropDuplicates([id_col]))
