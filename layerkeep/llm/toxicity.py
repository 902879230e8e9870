"""Toxicity: a weighted lexicon matched by Aho-Corasick over folded text.

Folding maps letters that look alike to one (accents dropped; Cyrillic, Greek,
full-width and mathematical forms to Latin) and digits and signs that stand for
letters to those letters; all else becomes a space. The lexicon holds word
beginnings and whole words with weights, learnt from labelled rows: entries
whose documents are toxic far more often than chance allows. Exception phrases
are an entry with the word before or after it that clean documents hold far
more often than toxic ones; a hit inside one counts nothing. The score is a
logistic function of the weight of the hits, alone and per hundred words.

Learning uses at most ``SAMPLE_TOXIC`` and ``SAMPLE_CLEAN`` labelled rows, those
whose hashed ids are least, and fewer where their texts, which are taken whole,
pass ``SAMPLE_CHARS`` characters together; two
thirds choose the lexicon, the rest fit the logistic function. Of near copies
in the sample one is kept. Scoring reads whole texts.

Null and empty texts score as texts without hits, very long ones are read whole.
An empty table gives an empty result. Without labelled rows of
both kinds every score is 0. Rows are answered alone: repeated rows, null ids
and other columns change nothing. Labels that are null or neither 0 nor 1 are
left out; a document labelled more than once is toxic if any of its labels is.
"""

from __future__ import annotations

import hashlib
import json
import math
import unicodedata
import zlib
from collections import Counter
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cached, id_text, least_hashes, leaving_tidy, remainder, rows_of, table, written

SAMPLE_TOXIC, SAMPLE_CLEAN, SAMPLE_CHARS = 2_400, 3_600, 40_000_000
#: Lengths of word beginnings that may enter the lexicon.
STEM_MIN, STEM_MAX = 4, 10

#: Characters that stand for Latin letters.
LOOKALIKES = {
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "l", "€": "e",
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ё": "e", "н": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m",
    "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "ц": "u", "ѵ": "v", "ѡ": "w", "х": "x", "у": "y", "ɡ": "g", "ı": "i", "ł": "l", "ø": "o", "đ": "d",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "γ": "y", "ω": "w",
}


def fold_table() -> np.ndarray:
    """The byte (a-z or space) of every code point."""
    out = np.full(0x110000, 0x20, np.uint8)
    for i in [*range(0x3000), *range(0xFF00, 0xFFF0), *range(0x1D400, 0x1D800)]:
        c = LOOKALIKES.get(chr(i).lower()) or unicodedata.normalize("NFKD", chr(i))[:1].lower()
        c = LOOKALIKES.get(c, c)
        if len(c) == 1 and "a" <= c <= "z":
            out[i] = ord(c)
    return out


def fold(text: str, classes: np.ndarray) -> str:
    """The folded text between single leading and trailing spaces; combining marks go, so marked letters stay in their words."""
    text = unicodedata.normalize("NFC", text) if not text.isascii() else text
    raw = classes[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    return " " + raw.tobytes().decode("ascii") + " "


@dataclass
class Model:
    """``stems`` begin words, ``words`` are whole; ``before`` and ``after`` hold exception phrases as (entry, neighbour)."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: list[str] = field(default_factory=list)
    coefficients: list[float] = field(default_factory=list)


def log_likelihood(a: int, b: int, na: int, nb: int) -> float:
    """G statistic of a of na against b of nb."""
    out = 0.0
    for k, n in ((a, na), (b, nb)):
        for x, p in ((k, (a + b) / (na + nb)), (n - k, 1 - (a + b) / (na + nb))):
            if x and p:
                out += 2 * x * math.log(x / (n * p))
    return out


def entries_of(folded: str) -> set[str]:
    """What a document offers to the lexicon: `` stem`` and `` word ``."""
    out = set()
    for w in set(folded.split()):
        if len(w) >= STEM_MIN:
            out.add(f" {w} ")
            out.update(f" {w[:k]}" for k in range(STEM_MIN, min(STEM_MAX, len(w)) + 1))
    return out


def without_copies(texts: list[str], hashes: int = 6) -> list[str]:
    """The texts that share fewer than half of the least hashes of their rarer words with earlier ones: copies would pass for evidence."""
    words = [set(w for w in x.split() if len(w) >= STEM_MIN) for x in texts]
    spread = Counter(w for own in words for w in own)
    common = max(12, len(texts) // 20)
    seen: set[tuple[int, int]] = set()
    out = []
    for x, own in zip(texts, words, strict=True):
        rare = [w.encode() for w in own if spread[w] <= common]
        keys = {(k, min(zlib.crc32(w, k) for w in rare)) for k in range(hashes)} if rare else set()
        if not keys or 2 * len(keys & seen) < hashes:
            out.append(x)
        seen |= keys
    return out


def learn_lexicon(toxic: list[str], clean: list[str]) -> dict[str, float]:
    """Entries far above chance in toxic documents; of entries on one chain of beginnings the most telling one."""
    in_toxic = Counter(e for x in toxic for e in entries_of(x))
    least = max(3, len(toxic) // 500)
    candidates = {e: n for e, n in in_toxic.items() if n >= least}
    in_clean = Counter(e for x in clean for e in entries_of(x) if e in candidates)
    level = 2 * math.log(max(2, len(in_toxic))) + 8
    scored = []
    for e, n in candidates.items():
        m = in_clean[e]
        if n * len(clean) > 4 * m * len(toxic) and (g := log_likelihood(n, m, len(toxic), len(clean))) > level:
            scored.append((-g * (1 + 0.01 * len(e.strip())), e.endswith(" "), e, math.log(((n + 0.5) / (len(toxic) + 1)) / ((m + 0.5) / (len(clean) + 1)))))
    chosen: dict[str, float] = {}
    stems, beginnings = set(), set()
    for *_, e, w in sorted(scored):
        stem = e.rstrip()
        own = {stem[:k] for k in range(1, len(stem) + 1)}
        if stem not in beginnings and stems.isdisjoint(own):
            chosen[e] = w
            stems.add(stem)
            beginnings |= own
    return chosen


def matcher(weights: dict[str, float], exceptions: list[str]):
    import ahocorasick

    out = ahocorasick.Automaton()
    both: dict[str, tuple] = {e: (len(e), w, False) for e, w in weights.items()}
    both |= {e: (len(e), 0.0, True) for e in exceptions}
    for e, x in both.items():
        out.add_word(e, x)
    if both:
        out.make_automaton()
    return out if both else None


def hits(found, folded: str) -> list[tuple[int, int, float]]:
    """(start, end, weight) of the entries outside exception phrases."""
    got, spared = [], []
    for last, (size, w, exception) in found.iter(folded) if found else ():
        (spared if exception else got).append((last + 1 - size, last + 1, w))
    if spared:
        got = [x for x in got if not any(s <= x[0] and x[1] <= e for s, e, _ in spared)]
    return got


def features(found, folded: str) -> tuple[float, float]:
    weight = sum(w for _, _, w in hits(found, folded))
    words = max(1, len(folded.split())) if weight else 1
    return math.log1p(weight), math.log1p(100 * weight / words)


def learn_exceptions(weights: dict[str, float], toxic: list[str], clean: list[str]) -> list[str]:
    """Phrases of an entry and a neighbouring word that mark clean documents."""
    found = matcher(weights, [])
    counts = [Counter(), Counter()]
    for k, texts in enumerate((toxic, clean)):
        for x in texts:
            own = set()
            for s, e, _ in hits(found, x):
                end = x.find(" ", max(e - 1, s + 1))
                before, after = x[:s].rstrip().rsplit(" ", 1)[-1], x[end : end + 60].split()
                word = x[s:end].strip()
                if before:
                    own.add(f" {before} {word} ")
                if after:
                    own.add(f" {word} {after[0]} ")
            counts[k].update(own)
    nt, nc = len(toxic), len(clean)
    return sorted(e for e, m in counts[1].items() if m >= 4 and m * nt > 4 * counts[0][e] * nc and log_likelihood(counts[0][e], m, nt, nc) > 12)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, steps: int = 60) -> np.ndarray:
    """Slopes and intercept, both kinds of rows with equal weight; without any hit to learn from, the share of toxic rows."""
    if not x.any():
        share = (y.sum() + 0.5) / (len(y) + 1)
        return np.array([0.0] * x.shape[1] + [math.log(share / (1 - share))])
    x = np.column_stack([x, np.ones(len(x))])
    weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())) * len(y)
    b = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(b))
        b = b + np.linalg.solve(h, x.T @ (weight * (y - p)) - ridge * b)
    return b


def learn(rows: list[tuple[str, int]]) -> Model:
    classes = fold_table()
    toxic, clean = (without_copies([fold(t, classes) for t, y in rows if y == k]) for k in (1, 0))
    if not toxic or not clean:
        return Model()
    first = lambda x: x[: max(1, len(x) * 2 // 3)]
    rest = lambda x: x[len(x) * 2 // 3 :]
    weights = learn_lexicon(first(toxic), first(clean))
    exceptions = learn_exceptions(weights, first(toxic), first(clean)) if weights else []
    found = matcher(weights, exceptions)
    sets = [*((x, 1) for x in rest(toxic)), *((x, 0) for x in rest(clean))]
    b = fit_logistic(np.array([features(found, x) for x, _ in sets]), np.array([y for _, y in sets], float))
    return Model(weights, exceptions, [float(v) for v in b])


def sample(docs: DataFrame, labels: DataFrame) -> list[tuple[str, int]]:
    """(text, label) of the sampled rows; at most ``SAMPLE_TOXIC`` + ``SAMPLE_CLEAN`` of them reach the driver."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("i")).agg(F.max("toxic").cast("int").alias("y"))
    wanted = {1: SAMPLE_TOXIC, 0: SAMPLE_CLEAN}
    near = F.lit(False)
    for r in known.groupBy("y").count().collect():  # two rows at most
        near = near | (F.col("y") == r.y) & least_hashes(F.col("o"), wanted[r.y], r["count"])
    ranked = known.withColumn("o", F.xxhash64(F.col("i"), F.lit(11))).filter(near).withColumn("n", F.row_number().over(Window.partitionBy("y").orderBy("o", "i")))
    chosen = ranked.filter(F.col("n") <= F.when(F.col("y") == 1, SAMPLE_TOXIC).otherwise(SAMPLE_CLEAN))
    own = id_text(docs, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    known = own.join(F.broadcast(chosen.select("i", "y", "n")), F.col("doc_id") == F.col("i"))
    sizes = written(known.select("i", "y", "n", F.length("t").alias("size")), "sizes").collect()  # as many rows as are sampled, but for repeated ids
    taken, total = [], 0
    for r in sorted(sizes, key=lambda r: (r.n, r.y, r.i, r["size"])):
        if not taken or total + r["size"] <= SAMPLE_CHARS:
            taken.append((r.i, r["size"]))
            total += r["size"]
    if not taken:
        return []
    ids = docs.sparkSession.createDataFrame(taken, "i2 long, size long").distinct()
    got = known.join(F.broadcast(ids), (F.col("i") == F.col("i2")) & (F.length("t") == F.col("size"))).select("n", "y", "t")
    return [(r.t, r.y) for r in sorted(got.collect(), key=lambda r: (r.n, r.y, r.t))]


SCHEMA = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("n_hits", pa.int64()), ("weight", pa.float64())])


class Scorer:
    def __init__(self, model: Model):
        self.model, self.classes, self.found = model, fold_table(), matcher(model.weights, model.exceptions)

    def score(self, text: str | None) -> tuple[float, int, float]:
        if not self.model.coefficients:
            return 0.0, 0, 0.0
        folded = fold(text or "", self.classes)
        got = hits(self.found, folded)
        weight = sum(w for _, _, w in got)
        words = max(1, len(folded.split())) if weight else 1
        z = math.log1p(weight), math.log1p(100 * weight / words), 1.0
        z = sum(a * b for a, b in zip(z, self.model.coefficients, strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z)))), len(got), weight


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, n_hits, weight. The model (bounded by the sample) is broadcast."""
    held = docs.sparkSession.sparkContext.broadcast(asdict(model))
    key = hashlib.sha256(json.dumps(asdict(model), sort_keys=True).encode()).hexdigest()

    def run(batches):
        scorer = cached(f"toxicity:{key}", lambda: Scorer(Model(**held.value)))
        for batch in batches:
            for ids, texts in rows_of(batch):
                cols = zip(*map(scorer.score, texts), strict=True)
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, f.type) for c, f in zip(cols, list(SCHEMA)[1:], strict=True))], schema=SCHEMA)

    return id_text(docs, id_col, text_col).mapInArrow(leaving_tidy(run), "doc_id long, score double, n_hits long, weight double")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = learn(sample(docs, labels.filter(remainder(F.col("doc_id"), 5) != 0)))
    held_out = (remainder(F.col("doc_id"), 5) == 0).alias("held_out")
    return score(docs, model).select("doc_id", held_out, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_hits")
