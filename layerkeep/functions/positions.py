"""Source positions: which of two updates of one key is newer."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import FailedPrecondition, InvalidArgument
from .hashing import whole

STALE, IDEMPOTENT, NEWER = "stale", "idempotent", "newer"
MAX_OFFSET = 2**63 - 1


def classify(current: tuple[int, int], candidate: tuple[int, int]) -> str:
    """Of (partition, offset): higher offsets are newer; other partitions cannot be compared."""
    if min(*current, *candidate) < 0:
        raise InvalidArgument("a source position is negative")
    if current[0] != candidate[0]:
        raise FailedPrecondition("updates of one key come from different partitions")
    return STALE if candidate[1] < current[1] else IDEMPOTENT if candidate[1] == current[1] else NEWER


def classified(current: Column, candidate: Column) -> Column:
    """The same for offsets of one partition; the first update of a key (no current offset) is newer."""
    return F.when(candidate < current, STALE).when(candidate == current, IDEMPOTENT).otherwise(NEWER)


def parse_key(key: Column) -> Column:
    """The unsigned 64-bit key of decimal text, or null: digits only, no overflow."""
    text = key.cast("string")
    digits = F.ltrim(text, F.lit("0"))
    number = F.when(text.rlike(r"\A[0-9]+\z") & (F.length(digits) <= 20), F.when(digits == "", F.lit("0")).otherwise(digits).try_cast("decimal(38,0)"))
    return F.when(number <= whole(2**64 - 1), number.cast("decimal(20,0)"))
