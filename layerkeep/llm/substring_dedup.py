"""Substring dedup: every window of ``window`` consecutive words, hashed by Rabin-Karp.

A word is removed if a window that covers it has the same words as a window
that starts in a document with a smaller id. Windows are judged on the input.

1. Documents are dealt into groups of bounded size by id and text, so rows that
   repeat one id spread. A group's task hashes all its windows and keeps of equal ones the smallest id: this
   pre-aggregation sends a window that a third of all documents hold once for
   each group only. The sorted hashes, cut into ranges, travel as packed blocks.
   Groups and ranges grow with the input, tasks do not beyond ``MOST_TASKS``: a
   task then goes through several groups or ranges, one after another.
2. A range's task meets the blocks of all groups, finds each hash's smallest
   id, and answers each block with one bit for each of its hashes: whether a
   smaller id exists elsewhere.
3. The group's task hashes its texts again (from the same shuffle files, which
   Spark reuses), joins answers and own ids, and merges repeated windows into
   maximal intervals of words.

Two windows count as equal if 61 bits modulo 2^61 - 1 and 16 bits of another hash
modulo 2^31 - 1 are: among n distinct windows n^2 / 2^78 pairs are expected to be
equal by chance, far less than one up to some ten billion windows, hundreds
among the 10^13 windows of 100 TB.

Null text has no words. A document whose id is null never removes another's
words; all such count as one document after all others. Rows that repeat an id
are one document: they do not remove each other's words. An empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import wordhash
from .common import forget, id_text, leaving_tidy, table

WINDOW = 50
#: Bytes of text in a group, and windows in a range, on average.
GROUP_BYTES, RANGE_BYTES = 5_000_000, 8_000_000
#: Tasks of a shuffle at most.
MOST_TASKS = 20_000
LAST = np.iinfo(np.int64).max


class Group:
    """The windows of a group's texts."""

    def __init__(self, rows: pa.Table, window: int):
        ids = rows.column("doc_id").to_pylist()
        self.ids = np.array([LAST if x is None else x for x in ids], np.int64)
        self.texts, self.window = rows.column("text").to_pylist(), window
        self.counts, wide, narrow = wordhash.words(self.texts)
        self.doc_of_word = np.repeat(np.arange(len(ids)), self.counts)
        last = self.doc_of_word[window - 1 :]
        self.first_word = np.flatnonzero(self.doc_of_word[: len(last)] == last)  # of each window that lies in one document
        hashes = wordhash.mix(wordhash.runs(wide, window)[self.first_word])
        checks = wordhash.runs(narrow, window, wide=False)[self.first_word].astype(np.uint16)
        own = self.ids[self.doc_of_word[self.first_word]]
        order, heads = in_order(hashes, checks)
        self.hashes, self.checks = hashes[order][heads], checks[order][heads]
        self.least = np.minimum.reduceat(own[order], heads) if len(heads) else own
        self.place = np.empty(len(order), np.int64)  # of each window among the distinct hashes
        fresh = np.zeros(len(order), np.int64)
        fresh[heads] = 1
        self.place[order] = np.cumsum(fresh) - 1
        self.own = own

    def ranges(self, ranges: int) -> dict[int, slice]:
        """The ranges that the distinct hashes fall into, of ``ranges`` equal ones, and which hashes each has."""
        own = ((self.hashes >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
        starts = np.flatnonzero(np.diff(own, prepend=np.uint64(ranges)))
        ends = np.append(starts[1:], len(own))
        return {int(own[s]): slice(int(s), int(e)) for s, e in zip(starts, ends, strict=False)}

    def removed(self, elsewhere: np.ndarray) -> np.ndarray:
        """Whether each word is removed, given for each distinct hash whether a smaller id has it elsewhere."""
        gone = elsewhere[self.place] | (self.own > self.least[self.place]) if len(self.place) else np.zeros(0, bool)
        change = np.zeros(len(self.doc_of_word) + 1, np.int32)
        at = self.first_word[gone]
        change[at] += 1
        np.subtract.at(change, at + self.window, 1)
        return np.cumsum(change[:-1]) > 0


def in_order(hashes: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(an order in which equal hashes with equal checks stand together, where each such run begins)."""
    order = np.argsort(hashes, kind="stable")
    for again in (False, True):
        h, c = hashes[order], checks[order]
        same = h[1:] == h[:-1]
        fresh = np.ones(len(order), bool)
        fresh[1:] = ~same | (c[1:] != c[:-1])
        if again or not (same & fresh[1:]).any():
            return order, np.flatnonzero(fresh)
        order = np.lexsort((checks, hashes))


def pack(numbers: np.ndarray) -> bytes:
    """64-bit numbers by byte planes, compressed: planes of zeros cost nothing."""
    import zstandard

    planes = np.ascontiguousarray(numbers.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(raw: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").ravel()


def pack_ids(ids: np.ndarray) -> bytes:
    """Ids as places among the distinct ones, which stand before them."""
    known, place = np.unique(ids, return_inverse=True)
    return len(known).to_bytes(8, "little") + pack(np.concatenate([np.diff(known.view(np.uint64), prepend=np.uint64(0)), place.astype(np.uint64)]))


def unpack_ids(raw: bytes) -> np.ndarray:
    n = int.from_bytes(raw[:8], "little")
    both = unpack(raw[8:])
    return np.cumsum(both[:n], dtype=np.uint64).view(np.int64)[both[n:].view(np.int64)]


BLOCKS = pa.schema([("grp", pa.int32()), ("rng", pa.int32()), ("hashes", pa.binary()), ("checks", pa.binary()), ("ids", pa.binary())])


def blocks(rows: pa.Table, window: int, ranges: int) -> pa.Table:
    """A group's distinct hashes with their checks and least ids, a row for each range."""
    forget()
    own = Group(rows, window)
    group = rows.column("grp")[0].as_py()
    out = []
    for k, part in own.ranges(ranges).items():
        steps = np.diff(own.hashes[part], prepend=np.uint64(0))
        out.append((group, k, pack(steps), own.checks[part].tobytes(), pack_ids(own.least[part])))
    return pa.table([pa.array(c, f.type) for c, f in zip(list(zip(*out, strict=True)) or [[]] * 5, BLOCKS, strict=True)], schema=BLOCKS)


def answers(batches):
    """For each block of a range, one bit for each hash: whether another block has it with a smaller id. Blocks of a range come together."""
    held: list[dict] = []
    for batch in batches:
        for r in batch.to_pylist():
            if held and held[0]["rng"] != r["rng"]:
                yield answered(held)
                held = []
            held.append(r)
    if held:
        yield answered(held)


def answered(own: list[dict]) -> pa.RecordBatch:
    """The answers to all blocks of one range."""
    hashes = [np.cumsum(unpack(r["hashes"]), dtype=np.uint64) for r in own]
    ends = np.cumsum([len(h) for h in hashes])
    h = np.concatenate(hashes)
    hashes = []
    order, heads = in_order(h, np.concatenate([np.frombuffer(r["checks"], np.uint16) for r in own]))
    h = np.concatenate([unpack_ids(r["ids"]) for r in own])
    sizes = np.diff(np.append(heads, len(order)))
    least = np.repeat(np.minimum.reduceat(h[order], heads), sizes)
    later = np.empty(len(h), bool)
    later[order] = h[order] > least
    bits = [np.packbits(x).tobytes() for x in np.split(later, ends[:-1])]
    cols = {"grp": pa.array([r["grp"] for r in own], pa.int32()), "rng": pa.array([r["rng"] for r in own], pa.int32()), "bits": pa.array(bits, pa.binary())}
    return pa.RecordBatch.from_pydict(cols)


def intervals(gone: np.ndarray) -> list[dict]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
    return [{"start": int(s), "end": int(e)} for s, e in zip(edge[0::2], edge[1::2], strict=True)]


def finish(rows: pa.Table, heard: pa.Table, window: int, ranges: int, with_text: bool) -> pa.Table:
    own = Group(rows, window)
    parts = own.ranges(ranges)
    elsewhere = np.zeros(len(own.hashes), bool)
    for r in heard.to_pylist():
        part = parts[r["rng"]]
        elsewhere[part] = np.unpackbits(np.frombuffer(r["bits"], np.uint8), count=part.stop - part.start).astype(bool)
    gone = own.removed(elsewhere)
    bounds = np.append(0, np.cumsum(own.counts))
    out = {k: [] for k in ("n_words", "n_removed", "kept_sha256", "removed", "kept_text")}
    for k, text in enumerate(own.texts):
        words = (text or "").encode("utf-8", "surrogatepass").split()
        part = gone[bounds[k] : bounds[k + 1]]
        out["n_words"].append(len(words))
        out["n_removed"].append(int(part.sum()))
        spans = intervals(part) if out["n_removed"][-1] else []
        kept = words
        if spans:
            kept = [w for w, g in zip(words, part.tolist(), strict=True) if not g]
        raw = b" ".join(kept)
        out["kept_sha256"].append(hashlib.sha256(raw).hexdigest())
        out["removed"].append(spans)
        out["kept_text"].append(raw.decode("utf-8", "surrogatepass") if with_text else None)
    kinds = {"n_words": pa.int64(), "n_removed": pa.int64(), "kept_sha256": pa.string(), "removed": pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), "kept_text": pa.string()}
    return pa.table({"doc_id": rows.column("doc_id")} | {k: pa.array(v, kinds[k]) for k, v in out.items()})


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, with_text: bool = False) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256, removed (maximal intervals of word numbers), kept_text (on demand)."""
    spark = docs.sparkSession
    rows = id_text(docs, id_col, text_col)
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(1, -(-total // GROUP_BYTES))
    ranges = max(1, -(-total // RANGE_BYTES))
    dealt = rows.withColumn("grp", F.pmod(F.xxhash64("doc_id", "text"), F.lit(groups)).cast("int"))
    dealt = dealt.repartition(min(groups, MOST_TASKS), "grp")
    sent = dealt.groupBy("grp").applyInArrow(lambda t: blocks(t, window, ranges), "grp int, rng int, hashes binary, checks binary, ids binary")
    met = sent.repartitionById(min(ranges, MOST_TASKS), F.col("rng") % F.lit(min(ranges, MOST_TASKS)))
    if ranges > MOST_TASKS:
        met = met.sortWithinPartitions("rng")
    heard = met.mapInArrow(leaving_tidy(answers), "grp int, rng int, bits binary")
    ddl = "doc_id long, n_words long, n_removed long, kept_sha256 string, removed array<struct<start:long,end:long>>, kept_text string"
    done = dealt.groupBy("grp").cogroup(heard.groupBy("grp")).applyInArrow(lambda t, a: finish(t, a, window, ranges, with_text), ddl)
    return done if with_text else done.drop("kept_text")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("removed")
