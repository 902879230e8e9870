"""Synthetic rows with a column of every type, some of them null or empty, made by Spark from row numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import whole
from ..schema import Field, Schema

TYPES = ("bool", "string", "uint64", "int64", "int32", "int8")


def all_types(version: int = 3) -> Schema:
    """For each type a field ``one_<type>`` and a list ``many_<type>``."""
    fields = []
    for t in TYPES:
        fields.append(Field(len(fields) + 1, f"one_{t}", t))
        fields.append(Field(len(fields) + 1, f"many_{t}", t, is_list=True, encoding="element_dictionary" if t == "string" else "dictionary"))
    return Schema.of(version, *fields)


def _value(kind: str, h: Column) -> Column:
    return {
        "int8": F.pmod(h, F.lit(256)) - 128, "int32": F.shiftright(h, 33), "int64": h, "uint64": h.cast("decimal(20,0)") + whole(2**63),
        "bool": F.pmod(h, F.lit(2)) == 0, "string": F.concat(F.lit("text "), F.pmod(h, F.lit(9_999)).cast("string")),
    }[kind]


def _element(kind: str, hashed):
    return lambda k: _value(kind, hashed(k))


def generate(spark: SparkSession, rows: int, seed: int = 5) -> DataFrame:
    """item (decimal(20,0)) and the columns of ``all_types``; an eighth of all values null, and an eighth of the lists empty."""
    base = spark.range(rows)
    chance = lambda i: F.pmod(F.xxhash64(F.col("id"), F.lit(seed), F.lit(i), F.lit("gap")), F.lit(16))
    hashed = lambda i, k=0: F.xxhash64(F.col("id"), F.lit(seed), F.lit(i), k if isinstance(k, Column) else F.lit(k))
    cols = [F.col("id").cast("decimal(20,0)").alias("item")]
    for i, f in enumerate(all_types().fields):
        if not f.is_list:
            value = F.when(chance(i) >= 2, _value(f.type, hashed(i)).cast(f.spark_type))
        else:
            size = F.when(chance(i) < 4, 0).otherwise(1 + F.pmod(hashed(i), F.lit(7)))
            some = F.transform(F.sequence(F.lit(1), F.greatest(size, F.lit(1)).cast("int")), _element(f.type, lambda k, i=i: hashed(i, k)))
            value = F.when(chance(i) < 2, F.lit(None)).when(size == 0, F.array()).otherwise(some).cast(f.spark_type)
        cols.append(value.alias(f.name))
    return base.select(*cols)
