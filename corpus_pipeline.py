"""A cleaning pipeline over ``documents``: each stage works on all that the one before kept.

Language identification drops documents in which no language is recognised;
exact dedup and MinHash near-dedup keep one document of each group; benchmark
decontamination drops documents that hold an item of ``benchmark``; byte-level
BPE encodes what is left and decodes it again: its rows are the training set, all
columns of the documents with n_tokens, ids and the digests of both. Documents
without text are ``und`` and go first; very long ones are read whole by all
stages; empty tables stay empty. A row without an id cannot be
named by a decision and stays. Of rows that repeat an id and its text (but for
white space) one stays; an id with several texts is so many documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from layerkeep.llm import byte_bpe, decontaminate, exact_dedup, language_id, near_dedup
from layerkeep.llm.common import MOST_BROADCAST, delete_scratch, one_row_each, scratch_mark, table, without, written


#: Names a row in the stages' decisions.
KEY = "__row_key"


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with ``KEY``: the id; where an id has several texts, the text of least digest has the id and the others a hash of id and digest.

    Hashed keys are 2^62 or more, so that of equal or near copies rows with their own id stay.
    Where no id repeats, only ids are shuffled.
    """
    own = docs.withColumn(KEY, F.col("doc_id").cast("long"))
    again = written(own.filter(f"{KEY} is not null").groupBy(F.col(KEY).alias("__again")).count().filter("count > 1").select("__again"), "repeated")
    if not (n := again.count()):
        return own
    digest = F.sha2(exact_dedup.normalised(F.col("text")).cast("binary"), 256)
    some = own.join(F.broadcast(again) if n <= MOST_BROADCAST else again, F.col(KEY) == F.col("__again"))
    firsts = some.groupBy("__again").agg(F.min(digest).alias("__first"), F.max(digest).alias("__last")).filter("__first <> __last")
    firsts = written(firsts.select("__again", "__first"), "clashes")
    if not (n := firsts.count()):
        return own
    hashed = F.shiftrightunsigned(F.xxhash64(KEY, digest), 2).bitwiseOR(F.lit(1 << 62))
    both = own.join(F.broadcast(firsts) if n <= MOST_BROADCAST else firsts, F.col(KEY) == F.col("__again"), "left")
    return both.withColumn(KEY, F.when(F.col("__again").isNotNull() & (digest != F.col("__first")), hashed).otherwise(F.col(KEY))).drop("__again", "__first")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.keep_identified(docs, language_id.sample(language_id.training_rows(docs)))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = keyed(docs)
    gone = exact_dedup.resolve(rows, KEY).filter(~F.col("kept")).select("doc_id")
    return one_row_each(without(rows, gone, KEY), KEY).drop(KEY)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = keyed(docs)
    return without(rows, near_dedup.near_duplicates(rows, KEY).filter(~F.col("kept")).select("doc_id"), KEY).drop(KEY)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = keyed(docs)
    return without(rows, decontaminate.contaminated(rows, table(spark, sf_dir, "benchmark"), KEY).select("doc_id"), KEY).drop(KEY)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return byte_bpe.with_ids(docs, *byte_bpe.public_files())


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("byte_bpe", encode),
]

#: SQL cannot express language identification by cross-parsing; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; what the stages wrote meanwhile is deleted when the next one stands."""
    docs = table(spark, sf_dir, "documents")
    mark = scratch_mark()
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
        delete_scratch(spark, mark, docs)
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
