"""Layers of whole rows by key: the newest layer that has a key supplies its row.

A layer is a DataFrame (pk, row), one row for each key. There is no merging of
fields: a null field of the newest row wins too. ``visible`` unites the layers
with their rank, shuffles them once and keeps the first row of each key; a lone
layer, whose keys are unique, is returned as it is;
asking for some fields only prunes the others at the scans. Filters on pk pass
through to all layers.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..errors import InvalidArgument
from ..functions.hashing import signed

#: Keys that a lookup sends to every layer as a broadcast; beyond, keys and layers are shuffled.
MOST_BROADCAST = 1_000_000


def _columns(layer: DataFrame, fields: Sequence[str] | None) -> DataFrame:
    if fields is None:
        return layer.select("pk", "row")
    return layer.select("pk", F.struct(*[F.col("row").getField(f).alias(f) for f in fields]).alias("row"))


def visible(layers: Sequence[DataFrame], fields: Sequence[str] | None = None, source: str | None = None) -> DataFrame:
    """pk, row (and the winning layer's rank as ``source``); layers go from newest to oldest."""
    if not layers:
        raise InvalidArgument("no layers")
    ranked = [_columns(x, fields).withColumn("__rank", F.lit(k)) for k, x in enumerate(layers)]
    out = ranked[0]
    if len(ranked) > 1:
        for x in ranked[1:]:
            out = out.unionByName(x)
        place = F.row_number().over(Window.partitionBy("pk").orderBy("__rank"))
        out = out.withColumn("__place", place).filter("__place = 1")
    return out.select("pk", "row", F.col("__rank").alias(source)) if source else out.select("pk", "row")


def newer_wins(newer: DataFrame, older: DataFrame) -> DataFrame:
    """The rows of ``newer``, and of ``older`` those whose key it lacks; each is read once."""
    return visible([newer, older])


def keys_frame(spark: SparkSession, keys: Iterable[int]) -> DataFrame:
    """(pos, pk) of a list of unsigned keys; pk as bit patterns."""
    rows = [(i, signed(k)) for i, k in enumerate(keys)]
    return spark.createDataFrame(rows, "pos long, pk long")


def lookup(layers: Sequence[DataFrame], keys: DataFrame, n_keys: int | None = None, fields: Sequence[str] | None = None) -> DataFrame:
    """pos, pk, row for each requested (pos, pk): order and repeats by pos, a missing key has a null row.

    Each layer is cut to the requested keys first, by a broadcast where their
    number is known and bounded, so that only their rows are united.
    """
    wanted = keys.select("pk").distinct()
    if n_keys is not None and n_keys <= MOST_BROADCAST:
        wanted = F.broadcast(wanted)
    some = [x.join(wanted, "pk", "left_semi") for x in layers]
    found = visible(some, fields)  # whole rows: adaptive execution broadcasts them where their bytes are few
    return keys.select("pos", "pk").join(found, "pk", "left").select("pos", "pk", "row")


def point(layers: Sequence[DataFrame], key: int, fields: Sequence[str] | None = None) -> DataFrame:
    """pk, row of one key: a literal filter that reaches every layer's scan."""
    return visible([x.filter(F.col("pk") == F.lit(signed(key))) for x in layers], fields)


def duplicate_keys(rows: DataFrame, key: str = "pk") -> DataFrame:
    """The keys that occur more than once, with how often."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def bad_keys(rows: DataFrame, key: str) -> DataFrame:
    """The rows whose key is null or negative."""
    return rows.filter(F.col(key).isNull() | (F.col(key) < 0))


def sorted_rows(rows: DataFrame) -> DataFrame:
    """By key, as unsigned numbers."""
    from ..functions.hashing import unsigned_order

    return rows.orderBy(unsigned_order(F.col("pk")))
