"""Byte-level BPE encoding and decoding by DuckDB recursive queries in each partition.

A text is cut into pieces by the tokenizer's pattern. The distinct pieces of a
run of rows become rows (piece, position, token) of single bytes; a recursive
query joins neighbouring tokens with the merge table, contracts each piece's
leftmost pair of minimum rank, and goes on until no piece has a pair left. An
ordered aggregation then collects a piece's ids. A text's ids are those of its
pieces in order. Decoding joins the positions and ids of whole texts with the
vocabulary, and an ordered aggregation puts their bytes together again. No
special token is recognised. A piece that is a token as a whole has that id, as
in the public library, and needs no query.

What a worker has encoded it keeps for later rows, up to ``MOST_KEPT`` pieces;
beyond that it forgets all and starts anew, which changes no result. DuckDB
may not spill; the sizes of its queries are bounded.

Null text counts as empty: no ids, digests of the empty string. Very long texts
are encoded and decoded whole. Rows are answered alone, so repeated rows, null
ids and other columns change nothing. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import cached, id_text, leaving_tidy, rows_of, small_batches, table, tidy

#: Pieces that a worker keeps, about 200 bytes each; characters of a run of rows.
MOST_KEPT, RUN_CHARS = 400_000, 1_000_000
#: The same for ``with_ids``, whose workers carry whole rows beside a JVM that earlier stages have filled.
MOST_KEPT_WITH_ROWS, RUN_CHARS_WITH_ROWS = 150_000, 400_000
#: Rows of one recursive query at most, were every step to contract one pair; ids of one decoding query. They bound DuckDB's tables.
QUERY_ROWS, DECODED_IDS = 1_000_000, 200_000
#: A query takes a step for each contraction and keeps every step's rows, so longer pieces (bytes) go to ``contract_long``.
LONG_PIECE = 512

#: Fixed value: the pattern that SIMPLE stands for.
KNOWN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts of these characters only are cut by SIMPLE, which needs no Unicode tables beyond them; only where the pattern is KNOWN.
REPERTOIRE = re.compile("[\x00-ɏ‐-‧]*")
_L, _N, _S = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t\n\x0b\f\r \x85\xa0"
SIMPLE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")

# A piece's best pair is the least of rank, position, next position, packed into one number.
CONTRACT = """
WITH RECURSIVE step AS (
  SELECT piece, pos, tok, false AS done FROM bytes_of
  UNION ALL
  SELECT t.piece, t.pos, CASE WHEN t.pos = (b.best >> 16) & 65535 THEN b.best >> 32 ELSE t.tok END::INTEGER, b.best IS NULL
  FROM (SELECT piece, pos, tok FROM step WHERE NOT done) t LEFT JOIN (
    SELECT piece, min((rank::BIGINT << 32) | (pos::BIGINT << 16) | next_pos) AS best
    FROM (SELECT piece, pos, (tok::BIGINT << 32) | lead(tok) OVER w AS pair, lead(pos) OVER w AS next_pos, lead(piece) OVER w AS next_piece
          FROM step WHERE NOT done WINDOW w AS (ORDER BY (piece::BIGINT << 16) | pos)) JOIN merges USING (pair)
    WHERE next_piece = piece GROUP BY piece) b ON t.piece = b.piece
  WHERE b.best IS NULL OR t.pos <> (b.best & 65535))
SELECT piece, string_agg(id_hex, '' ORDER BY pos) AS ids
FROM step JOIN vocabulary USING (tok) WHERE done GROUP BY piece ORDER BY piece
"""
DECODE = """
SELECT item, string_agg(hex, '' ORDER BY pos) AS hex FROM ids_of JOIN vocabulary USING (tok) GROUP BY item ORDER BY item
"""


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a rank file."""
    with open(path, "rb") as f:
        return parse_ranks(f.read())


def parse_ranks(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line)}


class Codec:
    """Encoder and decoder of one process, with its DuckDB connection."""

    def __init__(self, raw_ranks: bytes, pattern: str):
        import duckdb
        import regex

        ranks = parse_ranks(raw_ranks)
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
        pairs = [(ranks[t[:i]] << 32 | ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        self.pairs = dict(pairs)
        self.put("merges", pair=pa.array(list(self.pairs), pa.int64()), rank=pa.array(list(self.pairs.values()), pa.int32()))
        ids = [r.to_bytes(4, "little").hex() for r in ranks.values()]
        self.put("vocabulary", tok=pa.array(list(ranks.values()), pa.int32()), hex=pa.array([t.hex() for t in ranks]), id_hex=pa.array(ids))
        self.of_byte = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        self.simple = pattern == KNOWN
        self.kept: dict[str, bytes] = {}  # ids of pieces
        self.most_kept = MOST_KEPT
        del pairs, ids
        tidy()

    def put(self, name: str, **columns) -> None:
        self.con.register("arrow_rows", pa.table(columns))
        self.con.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM arrow_rows")
        self.con.unregister("arrow_rows")

    def pieces(self, text: str) -> list[str]:
        if self.simple and REPERTOIRE.fullmatch(text):
            return SIMPLE.findall(text)
        return [m.group() for m in self.pattern.finditer(text)]

    def contract(self, pieces: list[bytes]) -> Iterator[bytes]:
        """The ids of each piece, as little-endian unsigned 32-bit integers."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        item = np.repeat(np.arange(len(pieces)), sizes)
        first = np.repeat(np.cumsum(sizes) - sizes, sizes)
        flat = np.frombuffer(b"".join(pieces), np.uint8)
        self.put("bytes_of", piece=item.astype(np.int32), pos=(np.arange(len(flat)) - first).astype(np.int32), tok=self.of_byte[flat])
        return map(bytes.fromhex, self.con.sql(CONTRACT).to_arrow_table()["ids"].to_pylist())

    def contract_long(self, piece: bytes) -> list[int]:
        """The same contractions for one long piece, found by a heap instead of a query's steps."""
        toks: list[int | None] = [int(x) for x in self.of_byte[np.frombuffer(piece, np.uint8)]]
        n = len(toks)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, toks[i], toks[i + 1]) for i in range(n - 1) if (r := self.pairs.get(toks[i] << 32 | toks[i + 1])) is not None]
        heapq.heapify(heap)

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (r := self.pairs.get(toks[i] << 32 | toks[j])) is not None:
                heapq.heappush(heap, (r, i, toks[i], toks[j]))

        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if toks[i] != a or j >= n or toks[j] != b:
                continue
            toks[i], toks[j] = r, None
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [x for x in toks if x is not None]

    def decode(self, many: list[np.ndarray]) -> list[bytes]:
        """The bytes of each sequence of ids."""
        sizes = np.fromiter(map(len, many), np.int64, len(many))
        item, flat = np.repeat(np.arange(len(many)), sizes), np.concatenate([np.asarray(x, np.int32) for x in many] or [np.zeros(0, np.int32)])
        out = [b""] * len(many)
        for k in range(0, len(flat), DECODED_IDS):  # a long sequence may go on in the next run
            part = slice(k, k + DECODED_IDS)
            self.put("ids_of", item=item[part], pos=np.arange(len(flat))[part], tok=flat[part])
            got = self.con.sql(DECODE).to_arrow_table().to_pydict()
            for i, h in zip(got["item"], got["hex"], strict=True):
                out[i] += bytes.fromhex(h)
        return out

    def learn(self, new: list[str]) -> None:
        """Encodes pieces that are not kept yet."""
        raw = [x.encode("utf-8", "surrogatepass") for x in new]
        for x, r in zip(new, raw, strict=True):
            if r in self.ranks:
                self.kept[x] = self.ranks[r].to_bytes(4, "little")
            elif len(r) > LONG_PIECE:
                self.kept[x] = np.array(self.contract_long(r), "<u4").tobytes()
        rest = [i for i, x in enumerate(new) if x not in self.kept]
        rows = np.cumsum([len(raw[i]) * (len(raw[i]) + 1) // 2 for i in rest])
        run = rows // QUERY_ROWS if len(rows) else rows
        for k in np.unique(run):
            own = [rest[j] for j in np.flatnonzero(run == k)]
            for i, ids in zip(own, self.contract([raw[i] for i in own]), strict=True):
                self.kept[new[i]] = ids

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        cut = [self.pieces(x) if x else [] for x in texts]
        missing = set().union(*cut).difference(self.kept)
        if len(self.kept) + len(missing) > self.most_kept:
            self.kept.clear()
            tidy()
            missing = set().union(*cut)
        self.learn(list(missing))
        for p in cut:
            yield b"".join([self.kept[x] for x in p])

    def round_trip(self, texts: list[str | None]) -> list[tuple[np.ndarray, str, str]]:
        """(ids, their SHA-256, SHA-256 of the bytes that they decode to) of each text."""
        ids = list(self.encode(texts))
        many = [np.frombuffer(x, "<u4") for x in ids]
        return [(m, hashlib.sha256(x).hexdigest(), hashlib.sha256(y).hexdigest()) for m, x, y in zip(many, ids, self.decode(many), strict=True)]


def codec(raw_ranks: bytes, pattern: str) -> Codec:
    return cached(f"bpe:{hashlib.sha256(raw_ranks + pattern.encode()).hexdigest()}", lambda: Codec(raw_ranks, pattern))


def _run(docs: DataFrame, path: str, pattern: str, ddl: str, schema: pa.Schema, answer, most_kept: int = MOST_KEPT, run_chars: int = RUN_CHARS) -> DataFrame:
    """``answer`` of the codec, first column, texts and columns from the text's on of a run of rows; the rank file (bounded: about 1 MB) is read once, on the driver, and broadcast."""
    with open(path, "rb") as f:
        ranks = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        own = codec(ranks.value, pattern)
        own.most_kept = most_kept
        for batch in batches:
            start = 0
            for _, texts in rows_of(batch, run_chars):
                rest = batch.slice(start, len(texts)).columns[1:]
                first = batch.column(0).slice(start, len(texts))
                start += len(texts)
                yield pa.RecordBatch.from_arrays(answer(own, first, texts, rest), schema=schema)

    return docs.mapInArrow(leaving_tidy(run), ddl)


def _id_lists(many: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, many)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, "<u4"), *many]).astype(np.int32), pa.int32()))


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids array<int>."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def answer(own: Codec, first: pa.Array, texts: list[str | None], rest) -> list[pa.Array]:
        return [first, _id_lists([np.frombuffer(x, "<u4") for x in own.encode(texts)])]

    return _run(id_text(docs, id_col, text_col), path, pattern, "doc_id long, ids array<int>", schema, answer)


def decode(rows: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, bytes binary: the ids' bytes by ordered aggregation; null or no ids give empty bytes."""
    with open(path, "rb") as f:
        ranks = rows.sparkSession.sparkContext.broadcast(f.read())
    schema = pa.schema([("doc_id", pa.int64()), ("bytes", pa.binary())])

    def run(batches):
        own = codec(ranks.value, "")
        for batch in batches:
            for i in range(0, batch.num_rows, 200):
                part = batch.slice(i, 200)
                many = [np.array(x or [], np.int32) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(own.decode(many), pa.binary())], schema=schema)

    return rows.selectExpr(f"cast({id_col} as long) doc_id", f"cast({ids_col} as array<int>) ids").mapInArrow(leaving_tidy(run), "doc_id long, bytes binary")


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: n_tokens and SHA-256 of the ids and of the bytes that they decode to."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def answer(own: Codec, first: pa.Array, texts: list[str | None], rest) -> list[pa.Array]:
        ids, one, two = zip(*own.round_trip(texts), strict=True)
        return [first, pa.array(list(map(len, ids)), pa.int64()), pa.array(one), pa.array(two)]

    return _run(id_text(docs, id_col, text_col), path, pattern, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", schema, answer)


#: Columns that ``with_ids`` adds.
ADDED = {"n_tokens": "long", "ids": "array<int>", "ids_sha256": "string", "decoded_sha256": "string"}


def with_ids(docs: DataFrame, path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """The rows with the columns of ``ADDED``; columns that have these names already are replaced."""
    small_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c not in ADDED or c == text_col]
    sent = [c for c in kept if c != text_col or docs.schema[c].dataType != T.StringType()]  # a text that is a string travels once
    rows = docs.select(F.lit(0).alias("__no_id"), F.col(text_col).cast("string").alias("__cut"), *sent)
    out = T.StructType([*docs.select(*kept).schema.fields, *T._parse_datatype_string(", ".join(f"{c} {t}" for c, t in ADDED.items() if c != text_col)).fields])
    schema = to_arrow_schema(out)

    def answer(own: Codec, first: pa.Array, texts: list[str | None], rest) -> list[pa.Array]:
        ids, one, two = zip(*own.round_trip(texts), strict=True)
        new = {"n_tokens": pa.array(list(map(len, ids)), pa.int64()), "ids": _id_lists(ids), "ids_sha256": pa.array(one), "decoded_sha256": pa.array(two)}
        own_columns = {text_col: rest[0]} | dict(zip(sent, rest[1:], strict=True))
        return [*(own_columns[c] for c in kept), *(new[c] for c in ADDED if c != text_col)]

    return _run(rows, path, pattern, out, schema, answer, MOST_KEPT_WITH_ROWS, RUN_CHARS_WITH_ROWS)


def public_files() -> tuple[str, str]:
    """The rank file and the pattern of the public tokenizer."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), *public_files())
