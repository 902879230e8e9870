"""Maintenance of layers: compaction, rebase, and when to compact."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..errors import FailedPrecondition
from ..schema import Layout
from .overlay import newer_wins
from .updates import DeltaStats, latest

MIB = 1 << 20


@dataclass(frozen=True)
class Thresholds:
    """From which values a realtime layer should be compacted; a compact layer rebased."""

    realtime_slot_bytes: int = 64 * MIB
    realtime_payload_bytes: int = 64 * MIB
    realtime_unique_key_ratio: float = 0.05
    realtime_load_factor: float = 0.60
    compact_bytes: int = 128 * MIB
    compact_full_ratio: float = 0.10


def should_compact(stats: DeltaStats, full_rows: int, limits: Thresholds = Thresholds()) -> bool:
    return (
        stats.load_factor >= limits.realtime_load_factor
        or stats.unique_key_ratio(full_rows) >= limits.realtime_unique_key_ratio
        or stats.slot_bytes >= limits.realtime_slot_bytes
        or stats.payload_bytes >= limits.realtime_payload_bytes
    )


def should_rebase(compact_rows: int, compact_bytes: int, full_rows: int, limits: Thresholds = Thresholds()) -> bool:
    return compact_bytes >= limits.compact_bytes or bool(full_rows) and compact_rows / full_rows >= limits.compact_full_ratio


def compacted(log: DataFrame, boundary: int, old_compact: DataFrame | None) -> DataFrame:
    """The next compact layer: realtime rows that arrived before ``boundary`` over the old one. The full layer takes no part."""
    newest = latest(log, boundary).select("pk", "row")
    return newest if old_compact is None else newer_wins(newest, old_compact)


def rebased(compact: DataFrame | None, full: DataFrame | None) -> DataFrame:
    """The next full layer: compact rows over full ones."""
    if full is None:
        raise FailedPrecondition("a rebase needs a full snapshot")
    return full.select("pk", "row") if compact is None else newer_wins(compact, full)


@dataclass(frozen=True)
class HashSettings:
    shards: int
    seed: int = 0
    version: int = 1


def check_rebase(layouts: list[Layout], settings: list[HashSettings], external_load_active: bool, leftover_realtime: int) -> None:
    """Raises where finishing a rebase would mix or lose rows."""
    if len({x.fingerprint for x in layouts}) > 1:
        raise FailedPrecondition("layers differ in their layout")
    if len(set(settings)) > 1:
        raise FailedPrecondition("layers differ in their hash settings")
    if external_load_active:
        raise FailedPrecondition("an external load is active")
    if leftover_realtime:
        raise FailedPrecondition(f"{leftover_realtime} realtime rows were not compacted")
