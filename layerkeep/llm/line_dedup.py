"""Line dedup: lines that many sites share are boilerplate and go.

For each line (trimmed, by two 64-bit hashes) a HyperLogLog sketch collects the
sites that hold it; partial sketches merge in the aggregation, so a line that a
third of all rows hold reaches its reducer as one sketch for each task. Lines
whose estimate is clear of the threshold are decided by it. Those within
``BAND`` of it get an exact distinct count of their sites. Lines of at least
``sites`` sites are removed from all documents.

Blank lines are never boilerplate. A row without a site counts for none. Null
text has no lines and keeps empty text; empty text has one blank line. Rows that
repeat are judged alike, each returned. An empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WHITE, join_small_groups, leaving_tidy, table, written

SITES = 10
#: log2 of a sketch's registers, and the share around the threshold that is counted exactly: six standard errors.
LOG_REGISTERS = 12
BAND = 6 * 1.04 / 2 ** (LOG_REGISTERS / 2)


def lines_of(rows: DataFrame) -> DataFrame:
    """doc_id, row_key, site, place, h1, h2 for every line that is not blank."""
    each = rows.select("doc_id", "row_key", "site", F.posexplode(F.split("text", "\n")).alias("place", "line"))
    bare = F.btrim("line", F.lit(WHITE))
    return each.filter(bare != "").select("doc_id", "row_key", "site", "place", F.xxhash64(bare).alias("h1"), F.xxhash64(bare, F.lit(1)).alias("h2"))


def site_sketches(lines: DataFrame) -> DataFrame:
    """h1, h2, n_rows, sketch of the sites."""
    return lines.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_rows"), F.hll_sketch_agg("site", F.lit(LOG_REGISTERS)).alias("sketch"))


def merged(sketches: DataFrame) -> DataFrame:
    """Sketches of several tables (say, of several days) as one."""
    return sketches.groupBy("h1", "h2").agg(F.sum("n_rows").alias("n_rows"), F.hll_union_agg("sketch").alias("sketch"))


def boilerplate(lines: DataFrame, sites: int) -> tuple[DataFrame, int]:
    """(h1, h2, n_rows of the lines that go, the number of all lines)."""
    repeated = F.col("n_rows") >= sites  # fewer rows cannot have as many sites
    counted = site_sketches(lines).withColumn("estimate", F.hll_sketch_estimate("sketch")).drop("sketch")
    held = written(counted.filter(repeated & (F.col("estimate") >= sites * (1 - BAND) - 1)), "line-sites")
    total = lines.count()
    near = F.col("estimate") <= sites * (1 + BAND) + 1
    pairs = join_small_groups(lines, held.filter(near).select("h1", "h2", "n_rows"), ["h1", "h2"], "n_rows", total)
    exact = pairs.groupBy("h1", "h2", "site").agg(F.max("n_rows").alias("n_rows")).groupBy("h1", "h2").agg(F.max("n_rows").alias("n_rows"), F.count("site").alias("n"))
    clear = held.filter(~near).select("h1", "h2", "n_rows")
    return written(clear.unionByName(exact.filter(F.col("n") >= sites).select("h1", "h2", "n_rows")), "boilerplate"), total


SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_lines", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept_text", pa.string())])
DDL = "doc_id long, n_lines long, n_removed long, kept_sha256 string, kept_text string"


def cut(with_text: bool):
    def run(batches):
        for batch in batches:
            out = []
            for doc_id, text, places in zip(*(batch.column(k) for k in ("doc_id", "text", "places")), strict=True):
                text, gone = text.as_py(), set(places.as_py() or ())
                lines = [] if text is None else text.split("\n")
                kept = "\n".join([x for k, x in enumerate(lines) if k not in gone]) if gone else text or ""
                digest = hashlib.sha256(kept.encode("utf-8", "surrogatepass")).hexdigest()
                out.append((doc_id.as_py(), len(lines), len(gone), digest, kept if with_text else None))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), SCHEMA, strict=True)], schema=SCHEMA) if out else pa.RecordBatch.from_pylist([], schema=SCHEMA)

    return run


def remove_boilerplate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", sites: int = SITES, with_text: bool = True) -> DataFrame:
    """Per row: doc_id, n_lines, n_removed, kept_sha256, kept_text."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(site_col).cast("string").alias("site"))
    rows = rows.withColumn("row_key", F.xxhash64("doc_id", "text"))
    lines = lines_of(rows)
    gone, total = boilerplate(lines, sites)
    flagged = join_small_groups(lines.drop("site"), gone, ["h1", "h2"], "n_rows", total, "left_semi")
    places = flagged.groupBy(F.col("doc_id").alias("d"), F.col("row_key").alias("r")).agg(F.collect_set("place").alias("places"))
    both = rows.join(places, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("row_key") == F.col("r")), "left")
    return both.select("doc_id", "text", "places").mapInArrow(leaving_tidy(cut(with_text)), DDL)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_boilerplate(table(spark, sf_dir, "documents"), with_text=False).drop("kept_text")


ORACLE = r"""
WITH l AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS place
  FROM documents),
t AS (SELECT *, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM l),
b AS (SELECT bare FROM t WHERE bare <> '' GROUP BY bare HAVING count(DISTINCT source) >= 10),
f AS (SELECT t.*, b.bare IS NOT NULL AS gone FROM t LEFT JOIN b USING (bare)),
g AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
         coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT gone), '') AS kept
  FROM f GROUP BY doc_id)
SELECT d.doc_id, coalesce(g.n_lines, 0) AS n_lines, coalesce(g.n_removed, 0) AS n_removed, sha256(coalesce(g.kept, '')) AS kept_sha256
FROM documents d LEFT JOIN g USING (doc_id)
"""
