"""Exact dedup: a persistent digest index, bucketed and sorted by digest.

``ExactDedupIndex`` holds one row for each distinct normalised text that was
ever added. New data is deduplicated in itself, then against the index by a
sort-merge anti-join on the digest (the index side needs no shuffle or sort:
its table is bucketed and sorted by digest), and the survivors are appended.
``resolve`` puts a table through an index of its own and states for every row
which row of its group stays.

Everything is DataFrame operations. A null text counts as empty, very long ones
are read whole. A null id sorts before all others among ties. Rows that are
repeated are copies like any others (each is returned; the group counts all).
An empty table gives an empty result. Other columns are ignored by
``resolve`` and carried along by ``ExactDedupIndex.add``, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WHITE, join_small_groups, noted, partitions, shared_dir, table, written

def normalised(text):
    out = F.coalesce(text.cast("string"), F.lit(""))
    for c in WHITE:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars (code points of the original text), digest (32 bytes)."""
    text = F.col(text_col).cast("string")
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.length(text), F.lit(0)).cast("long").alias("n_chars"),
        F.unhex(F.sha2(normalised(text).cast("binary"), 256)).alias("digest"),
    )


def representatives(rows: DataFrame) -> DataFrame:
    """digest, keep_id, group_size: partial aggregation shrinks hot groups before the shuffle."""
    best = F.min(F.struct((-F.col("n_chars")).alias("n"), F.col("doc_id")))
    return rows.groupBy("digest").agg(best.getField("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))


def resolve(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_buckets: int | None = None) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the one with most code points in the original stays, then
    the one with the smallest doc_id. Of rows that repeat the very same id and
    length all carry ``kept`` (they are one document).
    """
    spark = docs.sparkSession
    index = ExactDedupIndex(spark, f"layerkeep_digests_{uuid.uuid4().hex[:12]}", n_buckets=n_buckets or partitions(spark))
    noted(index.path, index.name)
    rows = written(digests(docs, id_col, text_col), "digests")
    index.append(index.fresh(rows))
    both = join_small_groups(rows, index.table(), ["digest"], "group_size", rows.count())
    return both.select(
        "doc_id", "keep_id", F.col("group_size").cast("long"),
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


class ExactDedupIndex:
    """A digest index that lasts: its Parquet files lie under ``path``, its table is registered on use.

    ``add`` returns the rows of new data whose text is neither in the index
    nor an earlier choice within the data, one for each text, and appends their
    digests. The rows are decided and written before the index grows, so a lost
    executor or a retried task cannot make a document meet its own digest.
    """

    def __init__(self, spark: SparkSession, name: str, path: str | None = None, n_buckets: int = 64):
        self.spark, self.name, self.n_buckets = spark, name, n_buckets
        self.path = path or f"{shared_dir(spark)}/layerkeep/index-{name}"
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} (digest BINARY, keep_id BIGINT, group_size BIGINT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {n_buckets} BUCKETS LOCATION '{self.path}'"
        )

    def table(self) -> DataFrame:
        """digest, keep_id, group_size: how many rows had the text when it was added."""
        self.spark.catalog.refreshTable(self.name)
        return self.spark.table(self.name)

    def fresh(self, rows: DataFrame) -> DataFrame:
        """digest, keep_id, group_size of the texts of ``rows`` (as of ``digests``) that the index lacks: a sort-merge anti-join."""
        return written(representatives(rows).join(self.table().select("digest").hint("merge"), "digest", "left_anti"), "fresh")

    def append(self, fresh: DataFrame) -> None:
        laid = fresh.select("digest", "keep_id", "group_size").repartition(self.n_buckets, "digest")
        laid.write.format("parquet").mode("append").bucketBy(self.n_buckets, "digest").sortBy("digest").saveAsTable(self.name)

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        own = "__new"
        while any(c.startswith(own) for c in docs.columns):
            own += "_"
        fresh = self.fresh(digests(docs, id_col, text_col))
        text = F.col(text_col).cast("string")
        new = docs.withColumns({f"{own}1": F.unhex(F.sha2(normalised(text).cast("binary"), 256)), f"{own}2": F.coalesce(F.length(text), F.lit(0)), f"{own}3": F.coalesce(text, F.lit(""))})
        new = new.join(fresh.select(F.col("digest").alias(f"{own}4"), F.col("keep_id").alias(f"{own}5")), (F.col(f"{own}1") == F.col(f"{own}4")) & F.col(id_col).cast("long").eqNullSafe(F.col(f"{own}5")), "inner")
        # rows of the id that stays may differ in white space: the longest stays, then the least
        place = F.row_number().over(Window.partitionBy(f"{own}1").orderBy(F.desc(f"{own}2"), f"{own}3"))
        kept = written(new.withColumn(f"{own}6", place).filter(F.col(f"{own}6") == 1).select(*docs.columns), "kept")
        self.append(fresh)
        return kept


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_chars,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n_chars DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n_chars DESC, doc_id) AS kept,
       text_sha256
FROM n
"""
