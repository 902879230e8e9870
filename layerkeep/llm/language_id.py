"""Language identification by cross-parsing entropy.

For each language a suffix automaton of a bounded sample of labelled text
knows all substrings of that sample. A text is parsed from left to right into
phrases: each the longest match that the automaton allows. The fewer phrases,
the closer the text is to the language. Phrases times the logarithm of the
sample's size, per character, estimates the cross entropy; the language with
the least wins, ties go to the first in alphabetical order.

Characters are lower-cased; every run of them that are no letters counts as
one separator. A letter that a language's sample lacks is a phrase of its own.
Texts are parsed whole, in segments of ``SEGMENT`` characters so that many walk
their automata in lockstep. Each segment starts a new phrase.

The sample is bounded by rows, whose texts are taken whole: of each language
``SAMPLE_DOCS`` labelled rows, the shortest class of lengths first and by hashed
ids within it, and ``SAMPLE_ROWS`` in all, so with many languages there are fewer
of each. Beyond ``SAMPLE_ROWS`` languages the most common ones are learnt. All
letters of the sample are told apart; common ones step by a table, the others by
binary search.

Labels are read from training rows only. A text that is null, empty or without a
letter is ``und`` with score 0, as is every text if no row is labelled. The score
is 0 for a tie and nears 1 as the runner-up needs more phrases. Very long texts
are parsed whole, like all. Rows are answered alone: repeated rows, null ids and
other columns change nothing. A null lang is no label; a null id belongs to the
training rows or not by its empty text. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cached, id_text, least_hashes, leaving_tidy, remainder, rows_of, small_batches, table

#: Bounds of the sample: rows of each language, rows in all; texts of up to so many characters are one class of lengths, and each doubling is another.
SAMPLE_DOCS, SAMPLE_ROWS, SHORT = 24, 400, 2_000
#: Cells of the table of steps at most; letters that have no room in it are searched for.
CELLS = 20_000_000
SEGMENT = 1_024
UNKNOWN = "und"


def sample(training: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, str]:
    """Sample text by language; at most ``SAMPLE_ROWS`` rows are collected.

    Ids are chosen first, without texts; rows whose hash cannot be among the
    least go before the ranking, and each task ranks no more than it may send.
    """
    own = training.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).filter("lang is not null")
    length = F.greatest(F.lit(0), F.ceil(F.log2(F.length("text") / SHORT))).cast("int").alias("l")
    rows = own.filter(F.col("text").rlike(r"\p{L}")).select(F.col("doc").alias("i"), F.col("lang").alias("g"), F.xxhash64(F.col("doc"), F.lit(7)).alias("o"), length)
    common = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("l") == 0).alias("short")).orderBy(F.desc("n"), "g").limit(SAMPLE_ROWS).collect()
    most = min(SAMPLE_DOCS, SAMPLE_ROWS // max(1, len(common)))
    near = F.lit(False)
    for r in common:
        near = near | (F.col("g") == r.g) & (((F.col("l") == 0) & least_hashes(F.col("o"), most, r.short)) if r.short >= most else F.lit(True))
    chosen = rows.filter(near).withColumn("n", F.row_number().over(Window.partitionBy("g").orderBy("l", "o", "i")))
    ids = chosen.filter(F.col("n") <= most).select("i", "g", "n").distinct()
    got = own.join(F.broadcast(ids), F.col("doc").eqNullSafe(F.col("i")) & (F.col("lang") == F.col("g"))).groupBy("g", "n").agg(F.min("text").alias("t"))
    out: dict[str, str] = {}
    for r in sorted(got.collect(), key=lambda r: (r.g, r.n, r.t)):
        out[r.g] = out.get(r.g, "") + r.t + " "
    return out


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """The steps from each state of the automaton of all substrings; state 0 is dead, 1 is the root."""
    step: list[dict[int, int]] = [{}, {}]
    link, size, last = [0, 0], [0, 0], 1
    for c in symbols:
        cur = len(step)
        step.append({})
        size.append(size[last] + 1)
        link.append(1)
        p = last
        while p and c not in step[p]:
            step[p][c] = cur
            p = link[p]
        if p:
            q = step[p][c]
            if size[p] + 1 == size[q]:
                link[cur] = q
            else:
                clone = len(step)
                step.append(dict(step[q]))
                size.append(size[p] + 1)
                link.append(link[q])
                while p and step[p].get(c) == q:
                    step[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return step


class Parser:
    """The automata of all languages in one table, and the classes of characters.

    Classes go by how common their letters are: 0 is the separator, the last one
    is any letter that no sample has. The first ``width`` classes have cells in
    the table; steps by others are sorted keys (state, class).
    """

    def __init__(self, texts: dict[str, str]):
        self.languages = sorted(texts)
        letters: dict[str, int] = {}
        for g in self.languages:
            for c in texts[g].lower():
                if c.isalpha():
                    letters[c] = letters.get(c, 0) + 1
        known = sorted(letters, key=lambda c: (-letters[c], c))
        self.classes = np.zeros(0x110000, np.int32)
        self.classes[[i for i in range(0x110000) if chr(i).isalpha()]] = len(known) + 1
        for k, c in enumerate(known, 1):
            self.classes[ord(c)] = k
        base, self.roots, self.weight, states, symbols, targets = 1, [], [], [], [], []
        for g in self.languages:
            steps = suffix_automaton(self.folded(texts[g]).tolist())[1:]
            sizes = np.fromiter(map(len, steps), np.int64, len(steps))
            states.append(np.repeat(np.arange(base, base + len(steps)), sizes))
            symbols.append(np.fromiter((c for s in steps for c in s), np.int64, int(sizes.sum())))
            targets.append(np.fromiter((t for s in steps for t in s.values()), np.int64, int(sizes.sum())) + (base - 1))
            self.roots.append(base)
            self.weight.append(np.log2(max(2, len(texts[g]))))
            base += len(steps)
        states, symbols, targets = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (states, symbols, targets))
        self.all = len(known) + 2
        self.width = max(1, min(self.all, CELLS // base))
        self.steps = np.zeros(base * self.width, np.int32)
        inside = symbols < self.width
        self.steps[states[inside] * self.width + symbols[inside]] = targets[inside]
        keys = states[~inside] * self.all + symbols[~inside]
        order = np.argsort(keys)
        self.rare, self.rare_to = np.append(keys[order], np.iinfo(np.int64).max), np.append(targets[~inside][order], 0).astype(np.int32)
        roots = np.array(self.roots, np.int32)[:, None]
        at_root = np.zeros((len(self.languages), self.all), np.int32)
        for k, r in enumerate(self.roots):
            own = states == r
            at_root[k, symbols[own]] = targets[own]
        self.restart = np.where(at_root > 0, at_root, roots)

    def step(self, at: np.ndarray, c: np.ndarray) -> np.ndarray:
        """The states after one character, 0 where it does not go on."""
        if self.width == self.all or c.max() < self.width:
            return self.steps[at * self.width + c]
        out = self.steps[at * self.width + np.minimum(c, self.width - 1)]
        rare = np.flatnonzero(c >= self.width)
        keys = at[:, rare].astype(np.int64) * self.all + c[rare]
        place = np.searchsorted(self.rare, keys)
        out[:, rare] = np.where(self.rare[place] == keys, self.rare_to[place], 0)
        return out

    def folded(self, text: str) -> np.ndarray:
        """Classes of a text's characters, runs of separators as one."""
        out = self.classes[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
        if len(out) > 1:
            out = out[np.concatenate([[True], (out[1:] != 0) | (out[:-1] != 0)])]
        return out

    def phrases(self, rows: list[np.ndarray]) -> np.ndarray:
        """Phrases of each row for each language (languages x rows)."""
        which, parts = [], []
        for k, row in enumerate(rows):
            for i in range(0, len(row), SEGMENT):
                parts.append(row[i : i + SEGMENT])
                which.append(k)
        order = sorted(range(len(parts)), key=lambda i: -len(parts[i]))
        sizes = np.array([len(parts[i]) for i in order])
        out = np.zeros((len(self.languages), len(rows)))
        if not parts or not self.languages:
            return out
        grid = np.zeros((len(parts), sizes[0]), np.int32)
        for r, i in enumerate(order):
            grid[r, : sizes[r]] = parts[i]
        grid = np.ascontiguousarray(grid.T)
        roots = np.array(self.roots, np.int32)[:, None]
        at = np.repeat(roots, len(parts), axis=1)
        count = np.zeros(at.shape, np.int32)
        active = np.searchsorted(-sizes, -np.arange(sizes[0]), side="left")  # rows longer than t
        for t in range(sizes[0]):
            k = active[t]
            c = grid[t, :k]
            before = at[:, :k]
            here = self.step(before, c)
            dead = here == 0
            count[:, :k] += dead | (before == roots)  # a phrase begins
            at[:, :k] = np.where(dead, self.restart[:, c], here)
        docs = np.array(which)[order]
        for g in range(len(self.languages)):
            out[g] = np.bincount(docs, weights=count[g], minlength=len(rows))
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        rows = [self.folded(x) if x else np.zeros(0, np.int32) for x in texts]
        cost = self.phrases(rows) * np.array(self.weight)[:, None] if self.languages else np.zeros((0, len(rows)))
        lang, score = [], []
        for k, row in enumerate(rows):
            if not self.languages or not row.any():
                lang.append(UNKNOWN)
                score.append(0.0)
                continue
            own = cost[:, k]
            first = int(own.argmin())
            second = float(np.delete(own, first).min()) if len(own) > 1 else np.inf
            lang.append(self.languages[first])
            score.append(1.0 - float(own[first]) / second)
        return lang, score


SCHEMA = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])


def identify(docs: DataFrame, texts: dict[str, str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score. ``texts`` (bounded by the sample) is broadcast; each worker builds its automata once."""
    held = docs.sparkSession.sparkContext.broadcast(texts)
    key = hashlib.sha256(json.dumps(texts, sort_keys=True).encode()).hexdigest()

    def run(batches):
        parser = cached(f"languages:{key}", lambda: Parser(held.value))
        for batch in batches:
            for ids, held_texts in rows_of(batch, 3_000_000):
                lang, score = parser.predict(held_texts)
                yield pa.RecordBatch.from_arrays([ids, pa.array(lang, pa.string()), pa.array(score, pa.float64())], schema=SCHEMA)

    return id_text(docs, id_col, text_col).mapInArrow(leaving_tidy(run), "doc_id long, lang_pred string, score double")


def keep_identified(docs: DataFrame, texts: dict[str, str], text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose language is not ``und``."""
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(texts)
    key = hashlib.sha256(json.dumps(texts, sort_keys=True).encode()).hexdigest()
    at = docs.columns.index(text_col)

    def run(batches):
        parser = cached(f"languages:{key}", lambda: Parser(held.value))
        for batch in batches:
            kept = []
            for _, part in rows_of(batch.select([at, at]), 3_000_000):
                kept += [g != UNKNOWN for g in parser.predict(part)[0]]
            yield batch.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(leaving_tidy(run), docs.schema)


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.filter(remainder(F.col("doc_id"), 3) != 1)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = identify(docs, sample(training_rows(docs)))
    return out.select("doc_id", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score")
