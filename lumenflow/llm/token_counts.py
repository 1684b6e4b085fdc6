"""Token counts: unigram scores over a trie of distinct pre-tokens.

A pre-token is a maximal run without white space, with the word mark in front. Its tokens are the
segmentation into vocabulary pieces of the highest sum of log probabilities. The distinct pre-tokens of a
batch are inserted into a trie; a node holds the best (forward) score and token count of the prefix
that it ends, computed once from those of its ancestors, so what pre-tokens share is scored once.
Terminal counts stay with the Python worker over batches and tasks, up to MAX_HELD; forgetting them changes
no result. Counts are summed for each document where it lies: nothing is shuffled.

Characters that no piece covers cost UNKNOWN less than the worst piece and count as their UTF-8 bytes if the vocabulary
has byte pieces, else as one token.

Defined results
---------------
* Null, empty or blank texts have 0 tokens. Ties between segmentations: the one with the longer last piece, at every prefix.
* A null doc_id is counted; repeated rows are counted each. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import batch, lean

MARK = "▁"
UNKNOWN = 10.0
MAX_HELD = 500_000


@dataclass(frozen=True)
class Vocabulary:
    scores: dict[str, float]
    least: float
    bytes: bool


_loaded: dict = {}


def log_probabilities(scores: dict[str, float]) -> dict[str, float]:
    """Scores as they are if they are log probabilities. Whole numbers are merge ranks: they become log probabilities
    by Zipf's law, 1 / rank, since sums of ranks would prefer many frequent pieces to the word itself."""
    if not all(float(s).is_integer() for s in scores.values()):
        return scores
    order = sorted(scores, key=lambda piece: (-scores[piece], piece))
    total = math.log(sum(1 / r for r in range(1, len(order) + 1))) if order else 0.0
    return {piece: -math.log(r) - total for r, piece in enumerate(order, 1)}


def load(model_file: str) -> Vocabulary:
    """The ordinary pieces of a sentencepiece model file and their log probabilities."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=model_file)
    ids = range(p.get_piece_size())
    plain = log_probabilities({p.id_to_piece(i): p.get_score(i) for i in ids if not (p.is_byte(i) or p.is_control(i) or p.is_unknown(i) or p.is_unused(i))})
    return Vocabulary(plain, min(plain.values(), default=0.0), any(p.is_byte(i) for i in ids))


class Trie:
    """Scores of distinct pre-tokens, inserted in order: the trie is walked depth first, so only the path to the
    current node is held, and a node is scored once, when the walk first comes to it."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.counts: dict[str, int] = {}  # terminal counts
        self.nodes = 0
        # what a piece may end with: a search backwards from a node stops at the first string that isn't one
        self.endings = {piece[k:] for piece in vocabulary.scores for k in range(len(piece))}

    def insert(self, words: list[str]) -> None:
        """Score the pre-tokens that have no count yet."""
        scores, endings, counts = self.vocabulary.scores, self.endings, self.counts
        unknown, in_bytes = self.vocabulary.least - UNKNOWN, self.vocabulary.bytes
        before, best, tokens = "", [0.0], [0]
        for text in sorted(MARK + w for w in words if w not in counts):
            shared = 0
            for x, y in zip(before, text):
                if x != y:
                    break
                shared += 1
            del best[shared + 1 :], tokens[shared + 1 :]
            for end in range(shared + 1, len(text) + 1):
                top, count = -1e300, 0
                for start in range(end - 1, -1, -1):
                    piece = text[start:end]
                    if piece not in endings:
                        break
                    s = scores.get(piece)
                    if s is not None and (s := s + best[start]) >= top:
                        top, count = s, tokens[start] + 1
                if (c := text[end - 1]) not in scores and (s := best[end - 1] + unknown) > top:
                    top, count = s, tokens[end - 1] + (len(c.encode("utf-8", "replace")) if in_bytes else 1)
                best.append(top)
                tokens.append(count)
            self.nodes += len(text) - shared
            counts[text[1:]] = tokens[-1]
            before = text

    def of(self, words: list[str]) -> list[int]:
        """Counts of distinct pre-tokens."""
        if len(self.counts) > MAX_HELD:
            self.counts.clear()
        self.insert(words)
        return [self.counts[w] for w in words]


def worker_trie(model_file: str) -> Trie:
    """This worker's trie for a vocabulary."""
    if model_file not in _loaded:
        _loaded.clear()
        _loaded[model_file] = Trie(load(model_file))
    return _loaded[model_file]


def token_counts(docs: DataFrame, model_file: str) -> DataFrame:
    """doc_id, n_tokens of every row."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, texts in K.slices(b.column(1), max_bytes=8 << 20):  # more texts, more shared prefixes
                trie = worker_trie(model_file)
                t = K.Slice(texts, lower=False, table=K._SPACED)
                distinct, first, inverse = np.unique(t.hashes, return_index=True, return_inverse=True)
                counts = np.array(trie.of(t.words(first)), np.int64)
                total = np.bincount(t.doc, counts[inverse], t.n_docs) if len(distinct) else np.zeros(t.n_docs)
                yield batch(schema, b.column(0).slice(at, len(texts)), total.astype(np.int64))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lean(run), "doc_id long, n_tokens long")
