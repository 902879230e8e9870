"""MinHash near-dedup by an LSH forest over word shingles.

A document's set is its distinct shingles of ``shingle`` words (A-Z lower-cased).
Equal sets form a class at once, by a 128-bit digest. Each class has a MinHash
signature of ``TREES`` x ``DEPTH`` values, read as ``TREES`` words of ``DEPTH``
letters. The forest is those words in sorted order, tree by tree, dealt by
ranges, so that even a region that holds a third of all classes is spread over
tasks. Candidates of a class are its next ``NEIGHBOURS`` in each order among
those that share a prefix of at least ``LEAST_DEPTH`` letters: in a sparse region
that is everybody, in a dense one the classes with the longest common prefixes,
which is depth that adapts to the region.

Candidates are confirmed on full sets, in two rounds. First each class's best
candidates; that settles most groups. Then all candidates that still lie in
different components. Regions with more classes than neighbours reach, or cut by
a partition's bound, and with more than one component left, get an exact join:
a node is held against whole size classes and then blocks of nodes, by the
shingles that it would have to share, so no cap loses a link there.

A pair of similarity s shares a region in no tree with probability
(1 - s^LEAST_DEPTH)^TREES: 2e-6 at 0.75, and it falls fast above.

A document with fewer words than a shingle has its whole sequence as one
shingle; without words or with null text its set is empty and it links with
nothing. Null ids are one document, before all others, in no group. Rows that
repeat are copies like any others. An empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import wordhash
from .common import forget, id_text, join_small_groups, leaving_tidy, partitions, rows_of, table, written
from .components import components

SHINGLE, PERCENT = 5, 75
TREES, DEPTH, LEAST_DEPTH, NEIGHBOURS = 24, 6, 3, 2
#: Candidates of a class that are confirmed first.
BEST = 3
#: Shingles in a block's sets (8 bytes each), and nodes held against it in one task, on average; nodes of a component that has blocks of its own.
BLOCK, SIDE, LARGE = 1 << 19, 256, 256
#: Rows of an Arrow batch of shingles, on average.
UNPACKED = 100_000
#: A size class holds the sets of up to so many times its smallest set's shingles.
BAND = 1.1
#: Ids broadcast at most, counted first; beyond, the join shuffles.
MOST_BROADCAST = 1_000_000

_rng = np.random.default_rng(5)
MULTIPLY = _rng.integers(0, 2**31, TREES * DEPTH, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
FLIP = _rng.integers(0, 2**32, TREES * DEPTH, dtype=np.uint32)


def shingle_sets(texts: list[str | None], size: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's shingles."""
    counts, numbers, _ = wordhash.words(texts, lower=True)
    all_runs = wordhash.mix(wordhash.runs(numbers, size))
    out, start = [], 0
    for n in counts.tolist():
        if n >= size:
            out.append(np.unique(all_runs[start : start + n - size + 1]))
        else:
            out.append(wordhash.mix(wordhash.runs(numbers[start : start + n], n)))
        start += n
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """(sets x TREES * DEPTH) of 16 bits, big-endian; no set may be empty."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    flat = np.concatenate(sets)
    flat = (flat ^ (flat >> np.uint64(32))).astype(np.uint32)
    starts = np.cumsum(sizes) - sizes
    out = np.empty((TREES * DEPTH, len(sets)), np.uint16)
    for k in range(TREES * DEPTH):
        least = np.minimum.reduceat((flat ^ FLIP[k]) * MULTIPLY[k], starts)
        out[k] = (least * np.uint32(2654435761)) >> np.uint32(16)
    return out.T.astype(">u2")


def sketch(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n_shingles, digest, signature (both null without shingles)."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("signature", pa.binary())])

    def run(batches):
        forget()
        for batch in batches:
            for ids, texts in rows_of(batch, 3_000_000):
                sets = shingle_sets(texts, size)
                full = [s for s in sets if len(s)]
                rows = iter(signatures(full)) if full else iter(())
                made = [(len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest(), next(rows).tobytes()) if len(s) else (0, None, None) for s in sets]
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, f.type) for c, f in zip(zip(*made, strict=True), list(schema)[1:], strict=True))], schema=schema)

    return docs.mapInArrow(leaving_tidy(run), "doc_id long, n_shingles long, digest binary, signature binary")


PAIRS = "kind int, region binary, a long, b long"
PAIR_SCHEMA = pa.schema([("kind", pa.int32()), ("region", pa.binary()), ("a", pa.int64()), ("b", pa.int64())])


def neighbours(percent: int):
    """Over rows (tree, word, rep, n_shingles) in order: candidate pairs (kind 0), and the members of regions that neighbours do not cover (kind 1).

    A partition's first and last region may go on in the next one, so they count as not covered.
    """
    prefix = 2 * LEAST_DEPTH

    def region(members, edge):
        key = members[0][0], members[0][1][:prefix]
        for i, (_, _, rep, n) in enumerate(members):
            for _, _, other, m in members[i + 1 : i + 1 + NEIGHBOURS]:
                if 100 * min(n, m) >= percent * max(n, m):
                    yield 0, None, min(rep, other), max(rep, other)
        if edge or len(members) > NEIGHBOURS + 1:
            for _, _, rep, _ in members:
                yield 1, key[0].to_bytes(1, "big") + key[1], rep, None

    def rows(batches):
        held: list = []
        first = True
        for batch in batches:
            for x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (held[0][0] != x[0] or held[0][1][:prefix] != x[1][:prefix]):
                    if first or len(held) > 1:
                        yield from region(held, first)
                    held, first = [], False
                held.append(x)
        if held:
            yield from region(held, True)

    def run(batches):
        out = []
        for x in rows(batches):
            out.append(x)
            if len(out) == 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), PAIR_SCHEMA, strict=True)], schema=PAIR_SCHEMA)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), PAIR_SCHEMA, strict=True)], schema=PAIR_SCHEMA)

    return run


def forest(classes: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs and uncovered regions of all trees."""
    spark = classes.sparkSession
    tree = F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree")
    rows = classes.select("rep", "n_shingles", "signature", tree)
    rows = rows.select("tree", F.expr(f"substring(signature, tree * {2 * DEPTH} + 1, {2 * DEPTH})").alias("word"), "rep", "n_shingles")
    laid = rows.repartitionByRange(partitions(spark), "tree", "word", "rep").sortWithinPartitions("tree", "word", "rep")
    return laid.mapInArrow(leaving_tidy(neighbours(percent)), PAIRS)


def sets_of(docs: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """doc_id, shingles (binary: sorted 64-bit hashes) of the documents in ``ids``."""
    schema = pa.schema([("doc_id", pa.int64()), ("shingles", pa.binary())])

    def run(batches):
        for batch in batches:
            for own, texts in rows_of(batch, 3_000_000):
                yield pa.RecordBatch.from_arrays([own, pa.array([s.astype("<u8").tobytes() for s in shingle_sets(texts, size)], pa.binary())], schema=schema)

    side = F.broadcast(ids) if ids.count() <= MOST_BROADCAST else ids
    return docs.join(side, "doc_id", "left_semi").select("doc_id", "text").mapInArrow(leaving_tidy(run), "doc_id long, shingles binary")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        for batch in batches:
            same = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                s, t = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                both = len(s) + len(t) - len(np.union1d(s, t))
                same.append(100 * both >= percent * (len(s) + len(t) - both))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(same, pa.bool_())) for c in batch.columns[:2]], schema=schema)

    one = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x")), "a")
    two = one.join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y")), "b")
    return two.select("a", "b", "x", "y").mapInArrow(leaving_tidy(run), "a long, b long")


def apart(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """The pairs whose ends lie in different components; a node without one is its own."""
    for end in ("a", "b"):
        pairs = pairs.join(parts.select(F.col("node").alias(end), F.col("component").alias(f"c{end}")), end, "left")
    return pairs.filter(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")


def uncovered(regions: DataFrame, parts: DataFrame) -> DataFrame:
    """node, component, region of the members of regions that have more than one component; one of its regions for each."""
    rows = regions.join(parts, regions.a == parts.node, "left").select("region", F.col("a").alias("node"), F.coalesce("component", "a").alias("component"))
    mixed = rows.groupBy("region").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count(F.lit(1)).alias("size")).filter("x < y")
    left = join_small_groups(rows, mixed.select("region", "size"), ["region"], "size", rows.count(), "left_semi")
    return left.groupBy("node", "component").agg(F.min("region").alias("region"))


def band_of(n: Column) -> Column:
    """The size class of a set."""
    return F.floor(F.log(n.cast("double")) / float(np.log(BAND))).cast("int")


def least_of(band: Column) -> Column:
    """No set of a size class is smaller; rounding errs downwards."""
    return F.floor(F.pow(F.lit(BAND), band) * (1 - 1e-9))


def enough(shared: Column, n: Column, band: Column, percent: int) -> Column:
    """Whether a set of n shingles, ``shared`` of them with some set of the size class or another, may be similar to one of it."""
    least = F.greatest(least_of(band), n * percent / 100)
    return (shared * (100 + percent) >= percent * (n + least) - 1e-6) & (least_of(band) * percent <= 100 * n)


def in_blocks(rest: DataFrame, sets: DataFrame) -> DataFrame:
    """node, n, band, block: sets of about ``BLOCK`` shingles of one size class, of one large component or of regions put together."""
    total = rest.count()
    weighed = weights(rest, total)
    sizes = sets.select(F.col("doc_id").alias("node"), F.expr("octet_length(shingles) div 8").alias("n"))
    banded = weighed.join(sizes, "node").withColumn("band", band_of(F.col("n")))
    grouped = banded.withColumn("large", F.when(F.col("weight") >= LARGE, F.col("component")))
    sized = grouped.groupBy("band", "large").agg(F.ceil(F.sum("n") / BLOCK).alias("blocks"))  # few rows: size classes and large components
    placed = grouped.join(sized, grouped.band.eqNullSafe(sized.band) & grouped.large.eqNullSafe(sized.large)).drop(sized.band).drop(sized.large)
    near = F.when(F.col("large").isNull(), F.xxhash64("region")).otherwise(F.xxhash64("node"))
    return placed.select("node", "n", "band", F.xxhash64("band", F.coalesce("large", F.lit(-1)), F.pmod(near, "blocks")).alias("block"))


def weights(nodes: DataFrame, total: int) -> DataFrame:
    """``nodes`` with the number of them that their component has, as weight."""
    return join_small_groups(nodes, nodes.groupBy("component").agg(F.count(F.lit(1)).alias("weight")), ["component"], "weight", total)


_BLOCKS = ("node", "n", "band", "block")


def _unpack(batches):
    """A row for each shingle of each set, in batches of bounded size."""
    schema = pa.schema([(c, pa.int64()) for c in (*_BLOCKS, "h")])
    for batch in batches:
        sets = batch.column("shingles")
        sizes = pc.binary_length(sets).to_numpy(zero_copy_only=False) // 8
        runs = np.searchsorted(np.cumsum(sizes), np.arange(0, sizes.sum(), UNPACKED))
        for i, j in zip(runs, [*runs[1:], len(sets)], strict=True):
            if i < j:
                cols = [np.repeat(batch.column(c).slice(i, j - i).to_numpy(), sizes[i:j]) for c in _BLOCKS]
                own = np.concatenate([np.frombuffer(x.as_buffer(), "<i8") for x in sets.slice(i, j - i)])
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (*cols, own)], schema=schema)


def reach_of(percent: int) -> range:
    """How many size classes apart similar sets may be."""
    most = int(np.ceil(np.log(100 / percent) / np.log(BAND)))
    return range(-most, most + 1)


def may_link(rows: DataFrame, percent: int) -> DataFrame:
    """node, component, weight, band, common, bands: in which size classes a node may be similar to one of a larger component.

    Sets x and y are similar only if they share p (|x| + |y|) / (100 + p)
    shingles, so x is held against all nodes of a size class at once: those of
    its shingles that any of them in a larger component has must be as many.
    A shingle has one row, with the largest component for each size class, so
    the join makes as many rows as it reads, whatever the size of a group.
    ``common`` is the mean number of sets that a node's shingles stand in.
    """
    mark = F.struct("weight", "component")
    most = rows.groupBy("h", "band").agg(F.max(mark).alias("most"), F.count(F.lit(1)).alias("n"))
    most = most.groupBy("h").agg(F.map_from_entries(F.collect_list(F.struct("band", "most"))).alias("most"), F.sum("n").alias("df"))
    both = join_small_groups(rows, most.filter("df > 1"), ["h"], "df", rows.count())
    reach = reach_of(percent)
    shared = [F.sum((F.try_element_at("most", F.col("band") + k) > mark).cast("int")).alias(f"k{i}") for i, k in enumerate(reach)]
    counted = both.groupBy("node", "component", "weight", "n", "band").agg(*shared, (F.sum("df") / F.col("n")).alias("common"))
    bands = [F.when(enough(F.col(f"k{i}"), F.col("n"), F.col("band") + k, percent), F.col("band") + k) for i, k in enumerate(reach)]
    return counted.select("node", "component", "weight", "band", "common", F.array_compact(F.array(*bands)).alias("bands"))


def hub_pairs(rows: DataFrame, counted: DataFrame) -> DataFrame:
    """(a, b): each node that may link, with the ``BEST`` hubs that it shares most shingles with.

    A hub is the node of a component and size class whose shingles are the most
    common. For each shingle and size class that of the largest component counts.
    """
    hubs = counted.groupBy("component", "band").agg(F.max_by("node", F.struct("common", -F.col("node"))).alias("node"))
    able = counted.filter(F.size("bands") > 0).select("node", "bands")
    theirs = rows.join(hubs.select("node"), "node", "left_semi")
    theirs = theirs.groupBy("h", F.col("band").alias("their_band")).agg(F.max(F.struct("weight", "component", "node")).alias("hub"))
    own = rows.join(able, "node").select("h", "node", "weight", "component", F.explode("bands").alias("their_band"))
    met = own.join(theirs, ["h", "their_band"]).filter(F.struct("hub.weight", "hub.component") > F.struct("weight", "component"))
    votes = met.groupBy("node", F.col("hub.node").alias("hub")).agg(F.count(F.lit(1)).alias("votes"))
    place = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("votes"), "hub"))
    return votes.withColumn("place", place).filter(F.col("place") <= BEST).select(F.col("node").alias("a"), F.col("hub").alias("b"))


def block_links(percent: int):
    """Over the nodes of a block and the nodes to hold against it: a link of each of these with each component that has a similar set."""

    def run(own: pa.Table, others: pa.Table) -> pa.Table:
        a, b = [], []
        if own.num_rows and others.num_rows:
            sets = [np.frombuffer(x, "<u8") for x in own.column("shingles").to_pylist()]
            sizes = np.array([len(x) for x in sets])
            flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
            nodes, parts = own.column("node").to_numpy(), own.column("component").to_numpy()
            for node, part, raw in zip(*(others.column(c).to_pylist() for c in ("other", "other_component", "other_shingles")), strict=True):
                s = np.frombuffer(raw, "<u8")
                place = np.minimum(np.searchsorted(s, flat), len(s) - 1)
                both = np.bincount(owner[s[place] == flat], minlength=len(sets))
                alike = np.flatnonzero((100 * both >= percent * (sizes + len(s) - both)) & (parts != part))
                for i in alike[np.unique(parts[alike], return_index=True)[1]]:
                    a.append(node)
                    b.append(nodes[i])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def rest_parts(rest: DataFrame, parts: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``parts`` (node, component) after all links between different components of ``rest``.

    Nodes of smaller components are held against larger ones: first against
    whole size classes; those that pass against hubs, which links nearly all
    that can be linked; those that still pass against blocks by the same
    bound, and at last against the sets of the blocks that are left. Both
    bounds are exact, so no link is lost.
    """
    blocks = written(in_blocks(rest, sets), "blocks")
    full = blocks.join(sets, blocks.node == sets.doc_id).select(*blocks.columns, "shingles")
    rows = written(full.mapInArrow(leaving_tidy(_unpack), ", ".join(f"{c} long" for c in (*_BLOCKS, "h"))), "shingles")
    total = blocks.count()
    for hubs in (True, False):
        nodes = blocks.join(parts, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
        now = written(rows.join(weights(written(nodes, "nodes"), total), "node"), "weighed")
        counted = written(may_link(now, percent), "counted")
        if counted.filter(F.size("bands") > 0).isEmpty():
            return parts
        links = confirmed(hub_pairs(now, counted), sets, percent) if hubs else blockwise(now, counted, full, percent)
        parts = written(joined_up(parts, written(links, "confirmed")), "parts")
    return parts


def blockwise(rows: DataFrame, counted: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """All links (a, b) of nodes that may link with larger components, at least one for each node and component that it has a similar set in.

    The sets of a block travel once for ``SIDE`` nodes that meet it.
    """
    able = counted.filter(F.size("bands") > 0).select("node", "bands")
    mark = F.struct("weight", "component")
    theirs = rows.groupBy("h", "block", F.col("band").alias("their_band")).agg(F.max(mark).alias("most"))
    own = rows.join(able, "node").select("h", "node", "n", "bands", mark.alias("mark"))
    met = own.join(theirs, "h").filter((F.col("most") > F.col("mark")) & F.array_contains("bands", F.col("their_band")))
    met = met.groupBy("node", "n", "block", "their_band").agg(F.count(F.lit(1)).alias("shared"))
    met = written(met.filter(enough(F.col("shared"), F.col("n"), F.col("their_band"), percent)).select("node", "block"), "met")
    parts = met.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / SIDE).cast("int").alias("parts"))
    full = full.join(rows.select("node", "component").distinct(), "node").select("node", "component", "block", "shingles")
    others = met.join(parts, "block").join(full.drop("block"), "node").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    own = full.join(parts, "block").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    names = {"block": "to_block", "part": "to_part", "node": "other", "component": "other_component", "shingles": "other_shingles"}
    others = others.select(*[F.col(k).alias(v) for k, v in names.items()])
    return own.drop("parts").groupBy("block", "part").cogroup(others.groupBy("to_block", "to_part")).applyInArrow(block_links(percent), "a long, b long")


def link_classes(docs: DataFrame, classes: DataFrame, size: int, percent: int) -> DataFrame:
    """node, component of the classes that are linked with others."""
    found = written(forest(classes, percent), "forest")
    pairs = written(found.filter("kind = 0").groupBy("a", "b").agg(F.count(F.lit(1)).alias("trees")), "pairs")
    regions = found.filter("kind = 1").select("region", "a")
    ends = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).union(regions.select("a")).distinct()
    sets = written(sets_of(docs, written(ends, "ends"), size).dropDuplicates(["doc_id"]), "sets")
    first = written(best_pairs(pairs), "first")
    parts = written(components(written(confirmed(first, sets, percent), "confirmed")), "parts")
    more = written(confirmed(apart(pairs.join(first, ["a", "b"], "left_anti"), parts), sets, percent), "confirmed")
    parts = written(joined_up(parts, more), "parts")
    rest = written(uncovered(regions, parts), "uncovered")
    return parts if rest.isEmpty() else rest_parts(rest, parts, sets, percent)


def best_pairs(pairs: DataFrame) -> DataFrame:
    """The ``BEST`` candidates of each node that share most trees with it; a node has no more than 4 x TREES x NEIGHBOURS."""
    side = lambda x, y: pairs.select(F.col(x).alias("u"), F.col(y).alias("v"), "trees")
    place = F.row_number().over(Window.partitionBy("u").orderBy(F.desc("trees"), "v"))
    best = side("a", "b").unionByName(side("b", "a")).withColumn("place", place).filter(F.col("place") <= BEST)
    return best.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct()


def joined_up(parts: DataFrame, links: DataFrame) -> DataFrame:
    """``parts`` (node, component) after more links: only the components that they join are gone over again."""
    if links.isEmpty():
        return parts
    ends = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
    known = parts.unionByName(ends.join(parts, "node", "left_anti").select("node", F.col("node").alias("component")))
    for end in ("a", "b"):
        links = links.join(known.select(F.col("node").alias(end), F.col("component").alias(f"c{end}")), end)
    again = components(links.select(F.col("ca").alias("a"), F.col("cb").alias("b")))
    again = again.select(F.col("node").alias("component"), F.col("component").alias("now"))
    return known.join(again, "component", "left").select("node", F.coalesce("now", "component").alias("component"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, kept."""
    rows = id_text(docs, id_col, text_col)
    sketched = written(sketch(rows, size), "sketches")
    full = sketched.filter(F.col("digest").isNotNull() & F.col("doc_id").isNotNull())
    least = F.min(F.struct("doc_id", "n_shingles", "signature")).alias("m")
    classes = full.groupBy("digest").agg(least, F.count(F.lit(1)).alias("size"))
    classes = written(classes.select("digest", F.col("m.doc_id").alias("rep"), F.col("m.n_shingles").alias("n_shingles"), F.col("m.signature").alias("signature"), "size"), "classes")
    parts = link_classes(rows, classes, size, percent)
    named = classes.join(parts, classes.rep == parts.node, "left").select("digest", "size", F.coalesce("component", "rep").alias("component_id"))
    members = join_small_groups(full.select("doc_id", "n_shingles", "digest"), named, ["digest"], "size", sketched.count())
    alone = sketched.filter(F.col("digest").isNull() | F.col("doc_id").isNull()).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    out = members.select("doc_id", "n_shingles", "component_id").unionByName(alone)
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
