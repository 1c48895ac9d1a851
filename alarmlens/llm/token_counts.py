"""Token counts of a unigram tokenizer by dynamic programming over a trie.

Pre-tokens are words with the piece file's word mark before them.  A worker keeps one trie for all batches that it sees:
each node has its children, the forward score of its prefix (the best sum of log-probabilities of pieces that spell it) and
the number of pieces of that best way.  A word that is new is inserted from the root down; nodes that an earlier word made,
in this batch or an earlier one, are not scored again.  The node where a word ends is its terminal, whose count is the
word's.  A document's count is the sum over its words.  Everything is local to a worker: nothing is shuffled, and the trie
is bounded; beyond ``most`` nodes it is begun anew, which changes no count.

The model's pieces come from a public vocabulary.  Tokenizers are not trained here, and this vocabulary's file has ranks
only, so the log-probability of the piece of rank r is that of Zipf's law, -log(r + 1) less a constant.  A character that no
piece covers falls back to its bytes, each at the lowest log-probability of all.  Of equally good ways the one with fewer
pieces counts.

Defined results: null and empty texts count 0; any Unicode white space separates words; repeated rows get equal counts.
"""

from __future__ import annotations

import math
from array import array
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import boxed

MARK = "▁"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class UnigramTrie:
    """Counts of words; ``most`` nodes are kept."""

    def __init__(self, pieces: dict[str, float], most: int = 600_000):
        self.pieces, self.most = pieces, most
        self.floor = min(pieces.values(), default=0.0)
        ends: dict[str, set[int]] = {}
        for p in pieces:
            ends.setdefault(p[-1], set()).add(len(p))
        self.ends = {c: sorted(n) for c, n in ends.items()}
        self.scored = 0  # forward steps so far
        self.clear()

    def clear(self) -> None:
        self.child: dict[tuple[int, str], int] = {}
        self.score, self.counts = array("d", [0.0]), array("q", [0])
        self.terminal: dict[str, int] = {}

    def insert(self, words: list[str]) -> None:
        """Insert words; the path of the word before is kept open, so that sorted words walk no shared prefix twice."""
        pieces, ends, floor = self.pieces, self.ends, self.floor
        child, score, counts = self.child, self.score, self.counts
        path, last = [0], ""
        for word in sorted(words):
            text = MARK + word
            at = 0
            for a, b in zip(text, last, strict=False):
                if a != b:
                    break
                at += 1
            del path[at + 1 :]
            node = path[at]
            for end in range(at + 1, len(text) + 1):
                c = text[end - 1]
                key = node, c
                node = child.get(key)
                if node is None:
                    best, n = -math.inf, 0
                    for size in ends.get(c, ()):
                        if size > end:
                            break
                        p = pieces.get(text[end - size : end])
                        if p is not None:
                            before = path[end - size]
                            s = score[before] + p
                            if s > best or s == best and counts[before] + 1 < n:
                                best, n = s, counts[before] + 1
                    if best == -math.inf:
                        width = len(c.encode("utf-8", "surrogatepass"))
                        best, n = score[path[end - 1]] + width * floor, counts[path[end - 1]] + width
                    node = child[key] = len(score)
                    score.append(best)
                    counts.append(n)
                    self.scored += 1
                path.append(node)
            self.terminal[word] = node
            last = text

    def count(self, text: str) -> tuple[int, int]:
        """Words and tokens of one text."""
        words = text.split()
        new = [w for w in set(words) if w not in self.terminal]
        if new:
            if len(self.score) > self.most:
                self.clear()
                new = list(set(words))
            self.insert(new)
        terminal, counts = self.terminal, self.counts
        return len(words), sum([counts[terminal[w]] for w in words])


def zipf_pieces(path: str) -> dict[str, float]:
    """Pieces of a vocabulary file with log-probabilities by rank; control and byte pieces take no part."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    total = math.log(math.fsum(1 / (r + 1) for r in range(len(names))))
    out: dict[str, float] = {}
    for rank, name in enumerate(names):
        out.setdefault(name, -math.log(rank + 1) - total)
    return out


@lru_cache(maxsize=2)
def _trie(path: str) -> UnigramTrie:
    return UnigramTrie(zipf_pieces(path))


def count_tokens(docs: DataFrame, text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """``docs`` with ``n_words`` and ``n_tokens`` (in the place of columns of these names, if there)."""
    path = vocabulary or default_vocabulary()

    @F.pandas_udf("n_words long, n_tokens long")
    def udf(texts: pd.Series) -> pd.DataFrame:
        trie = _trie(path)
        rows = [trie.count(x) if isinstance(x, str) else (0, 0) for x in texts]
        return pd.DataFrame(np.array(rows, np.int64).reshape(-1, 2), columns=["n_words", "n_tokens"])

    counted = boxed(docs).withColumn("_counts", udf(F.col(f"_doc.`{text_col}`")))
    kept = [F.col(f"_doc.`{c}`").alias(c) for c in docs.columns if c not in ("n_words", "n_tokens")]
    return counted.select(*kept, "_counts.n_words", "_counts.n_tokens")
