"""Benchmark decontamination by template canonicalisation.

Numbers, names and units of a text become typed placeholders, so a question
whose figures or names were replaced keeps its template. Windows of ``window``
canonical tokens, and of as many lower-cased ones, are hash-joined with those of
the benchmark; each hit puts a benchmark item beside a document at some offset,
so an item that stands in a document whole is always found. For every such alignment the
share of the item's tokens that stand in the document at their places is
taken (the same token, or the same placeholder), and slot consistency is checked: over the matched placeholders of one
type, equal values of the item must stand for equal values of the document and
the other way round. An alignment with a share of at least ``least`` and
consistent slots is contamination.

Tokens are parted by white space and trimmed of punctuation; what is left empty
goes. A number begins with a digit and has only digits, ``.``, ``,``, ``:``,
``/``, ``-`` or one of the units behind it. A name begins with a capital, has a
lower-case letter and does not begin a sentence. Windows of canonical tokens need
half their tokens to be literal. An item with fewer than half literal is no
template: it has only lower-cased windows, and only equal tokens count. An item
shorter than the window is matched as a whole; one of fewer than
``LEAST_TOKENS`` tokens never matches.

Everything is DataFrame operations. Null and empty texts have no tokens, very long
ones are read whole. Rows that repeat
an id are one document, whose best alignment counts; null ids are one document.
Items with null text never match. Empty tables give an empty result; other
columns are ignored.

The benchmark's windows, its items and the alignments are broadcast up to
``MOST_BROADCAST`` rows and ``MOST_BYTES`` bytes, counted first; beyond, the joins
shuffle. Documents are read twice: once for the windows, and once for those of
the alignments, which are written to the shared folder before.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

WINDOW, LEAST_COVERAGE, LEAST_TOKENS = 8, 0.5, 4
#: Rows and bytes of a broadcast at most, both counted.
MOST_BROADCAST, MOST_BYTES = 500_000, 64_000_000
WHITE = " \t\n\x0b\f\r"
TRIM = ".,;:!?\"'()[]{}<>*%&$#@|_-=+~`/\\…«»“”‘’—–"
#: Stands before a token that begins a sentence.
MARK = "\x01"
_T = "".join(f"\\{c}" if c.isascii() else c for c in TRIM)
_W = r"\x20\x09-\x0D"
#: What parts tokens: white space with all punctuation around it; and such a stretch that holds the end of a sentence.
GAP = f"[{_T}]*+[{_W}][{_T}{_W}]*+"
SENTENCE_GAP = f"[.!?][{_T}]*+[{_W}][{_T}{_W}]*+"
#: Words that are units of measure.
UNITS = (
    "mm cm m km inch inches foot feet yard yards mile miles g kg mg ton tons pound pounds ounce ounces l ml liter liters litre litres gallon gallons "
    "second seconds minute minutes hour hours day days week weeks month months year years dollar dollars euro euros cent cents percent kmh mph degrees"
).split()


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once: lambda variables are not inlined."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def raw_tokens(text: Column) -> Column:
    """Trimmed tokens; those that begin a sentence carry ``MARK`` before them."""
    bare = F.btrim(F.coalesce(text.cast("string"), F.lit("")), F.lit(TRIM + WHITE))
    marked = F.concat(F.lit(MARK), F.regexp_replace(bare, F.lit(SENTENCE_GAP), F.lit(f"$0{MARK}")))
    return F.filter(F.split(marked, GAP), lambda t: ~t.isin("", MARK))


def plain(token: Column) -> Column:
    return F.lower(F.btrim(token, F.lit(MARK)))


def canonical_form(token: Column) -> Column:
    """A placeholder or the lower-cased token; most tokens begin with a small letter, so these come first."""
    code, units = F.ascii(token), [*UNITS]
    word = lambda t: F.when(F.lower(t).isin(units), F.lit("<unit>")).otherwise(F.lower(t))
    number = lambda t: t.rlike(rf"^[0-9][0-9.,:/-]*({'|'.join(UNITS)})?$")
    bare = F.substring(token, 2, 1_000_000_000)
    begins = F.when((F.ascii(bare) >= 48) & (F.ascii(bare) <= 57) & number(bare), F.lit("<num>")).otherwise(word(bare))
    large = ((code >= 65) & (code <= 90)) | ((code > 127) & (F.lower(F.substring(token, 1, 1)) != F.substring(token, 1, 1)))
    other = F.when(code == 1, begins).when((code >= 48) & (code <= 57) & number(token), F.lit("<num>")).when(large & (token != F.upper(token)), F.lit("<name>")).otherwise(word(token))
    return F.when((code >= 97) & (code <= 122), word(token)).otherwise(other)


def canonical(raw: Column) -> Column:
    return F.transform(raw, canonical_form)


def window_hashes(hashes: Column, k: int) -> Column:
    """Hashes of all windows of ``k`` tokens, in order, from the tokens' hashes.

    A window is made of two shorter ones, so ``k`` tokens take log k passes. The
    last k - 1 places, which are no windows, are cut off.
    """

    def of(h: Column, size: int) -> Column:
        if size == 1:
            return h
        half = 1 << (size - 1).bit_length() - 1
        if size - half == half:
            return let(of(h, half), lambda x: F.zip_with(x, shift(x, half), lambda a, b: F.xxhash64(a, b)))
        return F.zip_with(of(h, half), shift(of(h, size - half), half), lambda a, b: F.xxhash64(a, b))

    shift = lambda x, n: F.slice(x, n + 1, F.greatest(F.size(x) - n, F.lit(0)))
    return let(hashes, lambda h: F.slice(of(h, k), 1, F.greatest(F.size(h) - (k - 1), F.lit(0))))


def token_hashes(raw: Column) -> Column:
    return F.transform(raw, lambda t: F.xxhash64(canonical_form(t)))


def plain_hashes(raw: Column) -> Column:
    """Hashes of lower-cased tokens, apart from those of canonical ones."""
    return F.transform(raw, lambda t: F.xxhash64(plain(t), F.lit(1)))


def literal(token: Column) -> Column:
    return ~token.isin("<num>", "<name>", "<unit>")


def items_of(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """item_id, item_raw, item_canon, n_item, template (whether half the tokens are literal): the items that can match."""
    rows = benchmark.select(F.col(item_col).alias("item_id"), raw_tokens(F.col(text_col)).alias("item_raw"))
    rows = rows.select("item_id", "item_raw", canonical(F.col("item_raw")).alias("item_canon")).withColumn("n_item", F.size("item_canon"))
    return rows.filter(F.col("n_item") >= LEAST_TOKENS).withColumn("template", 2 * F.size(F.filter("item_canon", literal)) >= F.col("n_item"))


def item_windows(items: DataFrame, k: int, whole: bool) -> DataFrame:
    """w, item_id, q of the items' windows of k tokens: lower-cased ones, and those of templates with half their tokens literal; ``whole``: of items with k tokens only."""
    own = items.filter(F.col("n_item") == k) if whole else items.filter(F.col("n_item") >= k)
    rows = own.filter("template").select("item_id", "item_canon", F.posexplode(window_hashes(F.transform("item_canon", lambda t: F.xxhash64(t)), k)).alias("q", "w"))
    typed = rows.filter(2 * F.size(F.filter(F.slice("item_canon", F.col("q") + 1, F.lit(k)), literal)) >= k).select("w", "item_id", "q")
    return typed.unionByName(own.select("item_id", F.posexplode(window_hashes(plain_hashes(F.col("item_raw")), k)).alias("q", "w")))


def small(df: DataFrame, *sizes: str) -> DataFrame:
    """``df`` (a written table) for broadcast where its rows and the bytes of the named arrays are few, both counted."""
    weight = [F.size(c) * 40 + F.aggregate(c, F.lit(0), lambda n, x: n + F.length(x) * 4) for c in sizes]  # characters take 4 bytes at most
    seen = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(sum(weight, F.lit(64))), F.lit(0)).alias("bytes")).first()
    return F.broadcast(df) if seen.n <= MOST_BROADCAST and seen.bytes <= MOST_BYTES else df


def alignments(docs: DataFrame, items: DataFrame, window: int) -> DataFrame:
    """doc_id, item_id, offset: where windows of both are equal. Documents are read and cut into tokens once, whatever lengths short items have."""
    lengths = sorted(r.n_item for r in items.filter(F.col("n_item") < window).select("n_item").distinct().collect())  # at most window - 1 values
    sizes = [*lengths, window]
    sides = item_windows(items, window, False)
    for k in lengths:
        sides = sides.unionByName(item_windows(items, k, True))
    sides = written(sides, "windows")

    def windows(raw: Column) -> Column:
        """For each length the hashes of all windows: the canonical one of each place, then the lower-cased one."""
        both = lambda t, p, k: F.flatten(F.zip_with(window_hashes(t, k), window_hashes(p, k), lambda x, y: F.array(x, y)))
        return let(token_hashes(raw), lambda t: let(plain_hashes(raw), lambda p: F.array(*[both(t, p, k) for k in sizes])))

    found = docs.select("doc_id", F.explode(let(raw_tokens(F.col("text")), windows)).alias("x")).select("doc_id", F.posexplode("x").alias("at", "w"))
    found = found.join(small(sides), "w").select("doc_id", "item_id", (F.shiftright("at", 1) - F.col("q")).alias("offset"))
    return written(found.distinct(), "alignments")


def judged(pairs: DataFrame) -> DataFrame:
    """Coverage and slots of alignments that have text, item_raw, item_canon, n_item, template, offset.

    Tokens and their forms are bound before the walk over the item's places.
    """

    def walk(doc: Column) -> Column:
        def place(i: Column) -> Column:
            at = lambda a: F.when(i + F.col("offset") >= 0, F.get(a, i + F.col("offset")))
            theirs, ours = F.get("item_raw", i), at(doc.raw)
            alike = F.col("template") & (at(doc.canon) == F.get("item_canon", i)) | (plain(theirs) == plain(ours))
            return F.struct(F.coalesce(alike, F.lit(False)).alias("alike"), F.get("item_canon", i).alias("kind"), plain(theirs).alias("theirs"), plain(ours).alias("ours"))

        return F.filter(F.transform(F.sequence(F.lit(0), F.col("n_item") - 1), place), lambda x: x.alike)

    bound = let(raw_tokens(F.col("text")), lambda r: F.struct(r.alias("raw"), canonical(r).alias("canon")))
    pairs = pairs.withColumn("hits", let(bound, walk)).select("doc_id", "item_id", "n_item", "offset", "hits")
    rows = pairs.withColumn("slots", F.filter("hits", lambda x: ~literal(x.kind)))
    key = lambda *names: F.size(F.array_distinct(F.transform("slots", lambda x: F.struct(*[x[n] for n in names]))))
    both = key("kind", "theirs", "ours")
    return rows.select(
        "doc_id", "item_id", "n_item", F.size("hits").alias("n_matched"), F.size("slots").alias("n_slots"),
        ((both == key("kind", "theirs")) & (both == key("kind", "ours"))).alias("consistent"),
        (F.size(F.filter("hits", lambda x: x.theirs == x.ours)) == F.col("n_item")).alias("verbatim"),
        F.col("offset").alias("first_token"),
    )


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, least: float = LEAST_COVERAGE) -> DataFrame:
    """One row for each document and item that it contains: the best alignment."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    items = written(items_of(benchmark, item_col, item_text_col), "items")
    aligned = alignments(rows, items, window)
    some = rows.withColumnRenamed("doc_id", "d").join(small(aligned), F.col("d").eqNullSafe(F.col("doc_id"))).drop("d")
    pairs = some.join(small(items, "item_raw", "item_canon"), "item_id")
    found = judged(pairs).filter(F.col("consistent") & (F.col("n_matched") >= least * F.col("n_item")))
    best = F.max(F.struct("n_matched", "verbatim", (-F.col("first_token")).alias("at"), "n_item", "n_slots"))
    out = found.groupBy("doc_id", "item_id").agg(best.alias("b"))
    return out.select(
        "doc_id", "item_id", F.col("b.n_item").cast("long").alias("n_item"), F.col("b.n_matched").cast("long").alias("n_matched"),
        F.col("b.n_slots").cast("long").alias("n_slots"), F.col("b.verbatim").alias("verbatim"), (-F.col("b.at")).cast("long").alias("first_token"),
    )


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
