"""Token counts under a unigram vocabulary, without building tokens.

An Aho-Corasick automaton lists, for each end position, the vocabulary pieces
that end there, longest first. Dynamic programming carries for each position
the best score and the number of tokens of the path that has it. A candidate
replaces another only if its score is strictly higher, and candidates for one
end come with the earliest start first, as in the public unigram tokenizers;
so of equal scores the longer last piece wins. A character that no piece of
one character covers is unknown: it scores ten less than the worst piece and
counts as its UTF-8 bytes where the vocabulary has byte fallback, else as one.

Spaces become U+2581 and one is put before the text. Where no piece holds
U+2581 after another character, and none a line feed, the best path of a text
is the best paths of its words in a row, so words are solved once and kept;
else a text is solved whole. Scores are summed in double precision; with whole
numbers, as in rank-scored vocabularies, sums and ties are exact.

Null or empty text has no tokens. Rows are answered alone, so repeated rows,
null ids and other columns change nothing. (Implementations that sum in single
precision drift from the exact best path on long texts; this one does not.)
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import cached, id_text, leaving_tidy, rows_of, table

SPACE = "▁"
#: Words that a worker keeps, about 200 bytes each; beyond that it starts anew.
MOST_KEPT = 900_000
UNKNOWN_PENALTY = 10.0


@dataclass(frozen=True)
class Vocabulary:
    pieces: tuple[tuple[str, float], ...]
    byte_fallback: bool = True
    dummy_prefix: bool = True

    def digest(self) -> str:
        return hashlib.sha256(repr(self).encode()).hexdigest()


def read_pieces(path: str) -> Vocabulary:
    """The normal and user-defined pieces of a sentencepiece model file, with their scores."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    kinds = (pb.ModelProto.SentencePiece.NORMAL, pb.ModelProto.SentencePiece.USER_DEFINED)
    pieces = tuple((p.piece, float(p.score)) for p in model.pieces if p.type in kinds)
    return Vocabulary(pieces, model.trainer_spec.byte_fallback, model.normalizer_spec.add_dummy_prefix)


class Counter:
    def __init__(self, vocabulary: Vocabulary):
        import ahocorasick

        self.vocabulary, self.matcher = vocabulary, ahocorasick.Automaton()
        for piece, score in vocabulary.pieces:
            self.matcher.add_word(piece, (len(piece), score))
        self.matcher.make_automaton()
        self.singles = frozenset(p for p, _ in vocabulary.pieces if len(p) == 1)
        self.unknown = min(s for _, s in vocabulary.pieces) - UNKNOWN_PENALTY
        self.by_word = not any(SPACE in p.lstrip(SPACE) or "\n" in p for p, _ in vocabulary.pieces)
        self.words = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")
        self.kept: dict[str, int] = {}

    def solve(self, text: str) -> tuple[float, int]:
        """Best score and token count of a text that has its U+2581 already."""
        best, count = [0.0] * (len(text) + 1), [0] * (len(text) + 1)
        done = 0

        def open_next() -> bool:
            """Gives the next end its unknown candidate, which loses ties to any piece; whether it has one."""
            nonlocal done
            char = text[done]
            done += 1
            if char in self.singles:
                best[done] = -math.inf
                return False
            best[done], count[done] = best[done - 1] + self.unknown, count[done - 1] + self.tokens_of(char)
            return True

        weak = False
        for last, (size, score) in self.matcher.iter(text):
            end = last + 1
            while done < end:
                weak = open_next()
            s = best[end - size] + score
            if s > best[end] or weak and s == best[end]:
                best[end], count[end], weak = s, count[end - size] + 1, False
        while done < len(text):
            open_next()
        return best[-1], count[-1]

    def tokens_of(self, char: str) -> int:
        return len(char.encode("utf-8", "surrogatepass")) if self.vocabulary.byte_fallback else 1

    def count(self, texts: Iterable[str | None]) -> list[int]:
        out = []
        for x in texts:
            if not x:
                out.append(0)
                continue
            text = (SPACE if self.vocabulary.dummy_prefix else "") + x.replace(" ", SPACE)
            if not self.by_word:
                out.append(self.solve(text)[1])
                continue
            words, kept = self.words.findall(text), self.kept
            try:
                out.append(sum([kept[w] for w in words]))
            except KeyError:
                if len(kept) > MOST_KEPT:
                    kept.clear()
                for w in words:
                    if w not in kept:
                        kept[w] = self.solve(w)[1]
                out.append(sum([kept[w] for w in words]))
        return out


SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64())])


def token_counts(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens. The vocabulary (bounded by its file) is broadcast."""
    held, key = docs.sparkSession.sparkContext.broadcast((vocabulary.pieces, vocabulary.byte_fallback, vocabulary.dummy_prefix)), vocabulary.digest()

    def run(batches):
        counter = cached(f"unigram:{key}", lambda: Counter(Vocabulary(*held.value)))
        for batch in batches:
            for ids, texts in rows_of(batch):
                yield pa.RecordBatch.from_arrays([ids, pa.array(counter.count(texts), pa.int64())], schema=SCHEMA)

    return id_text(docs, id_col, text_col).mapInArrow(leaving_tidy(run), "doc_id long, n_tokens long")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), read_pieces(public_tokenizers.path("piece_bpe_32k.model")))
