"""Byte-level BPE: exact merges by longest matches and backtracking, in linear time, and decoding.

Text is cut by the tokenizer's pattern, and each piece is encoded by itself.  A piece's bytes are read as Latin-1 characters,
so that pyahocorasick can hold the vocabulary; one pass finds the longest token that begins at each byte.  From the left the
longest token is tried, then its shorter prefixes; a token may follow another only if the two are compatible, that is, if
merging the bytes of both gives just these two.  A byte from which no token leads on is marked and not tried again, so the
work is linear in the piece.  A row of tokens whose neighbours are all compatible is the one that the merges give.

Compatibility is found by taking both tokens apart along the seam, latest merge first, and looking for a merge across it that
would have come earlier; it is memoised for each pair.  How a token is merged of two others is found once for each token, by
the same test on tokens of lower rank.

A worker builds the tables once and keeps a bounded cache of short pieces.  Nothing is shuffled.  Long texts are cut, encoded
and hashed in blocks of pieces.

The library's pattern knows the letters and digits of one Unicode version, the regex package perhaps those of another: the
characters on which they differ are asked of the library once, and texts that may hold some are cut by a pattern without them.

Defined results: null and empty texts have no tokens, and the digests of nothing; repeated rows get equal results; special
tokens' strings are ordinary text.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BoundedCache, boxed

#: Pieces of a text that are held at once, and bytes of a piece that is kept in the cache.
BLOCK, SHORT = 200_000, 64


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class Merges:
    """Encoder of single pieces for the ``ranks`` of a vocabulary that holds all their bytes and lists tokens in the order of
    their merges."""

    def __init__(self, ranks: dict[bytes, int]):
        import ahocorasick

        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.size = {rank: len(token) for token, rank in ranks.items()}
        self._prefixes(ranks)
        self.merged: dict[tuple[int, int], int] = {}  # the two halves of each merged token
        self.halves: dict[int, tuple[int, int] | None] = {}
        for rank in sorted(self.bytes_of):
            self.halves[rank] = self._halves(rank)
            if self.halves[rank]:
                self.merged[self.halves[rank]] = rank
        # a token that no merges lead to stands only for a whole piece
        made = {token: rank for token, rank in ranks.items() if len(token) == 1 or self.halves[rank]}
        self._prefixes(made)
        self.words = ahocorasick.Automaton()
        for token, rank in made.items():
            self.words.add_word(token.decode("latin-1"), rank)
        self.words.make_automaton()
        self.known: dict[tuple[int, int], bool] = BoundedCache(lambda pair: self._compatible(*pair), 2_000_000)

    def _prefixes(self, ranks: dict[bytes, int]) -> None:
        """Of each token the longest one that is a proper prefix of it, or None."""
        self.prefix = {rank: next((ranks[token[:k]] for k in range(len(token) - 1, 0, -1) if token[:k] in ranks), None) for token, rank in ranks.items()}

    def _halves(self, rank: int) -> tuple[int, int] | None:
        token, left = self.bytes_of[rank], self.prefix[rank]
        while left is not None:
            right = self.ranks.get(token[self.size[left] :])
            if right is not None and max(left, right) < rank and all(self.size[x] == 1 or self.halves[x] for x in (left, right)) and self._compatible(left, right):
                return left, right
            left = self.prefix[left]
        return None

    def _compatible(self, left: int, right: int) -> bool:
        """Whether no merge across the seam comes before the merges that made the tokens on its sides.

        Walk back in time: the side that was merged later is taken apart and its half at the seam stands in for it.  A
        merge across the seam of what then stands there counts if it is earlier than the merges undone so far (at equal
        rank the left one of two places comes first)."""
        merged, halves = self.merged, self.halves
        bound = 1 << 60
        while True:
            across = merged.get((left, right))
            if across is not None and across < bound:
                return False
            a, b = halves[left], halves[right]
            if a is not None and (left > right or b is None):
                bound, left = left, a[1]
            elif b is not None:
                bound, right = right + 1, b[0]
            else:
                return True

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        size, prefix, known = self.size, self.prefix, self.known
        longest = [None] * len(piece)
        for end, rank in self.words.iter(piece.decode("latin-1")):
            start = end + 1 - size[rank]
            held = longest[start]
            if held is None or size[held] < size[rank]:
                longest[start] = rank
        open_ = bytearray(b"\x01") * (len(piece) + 1)  # bytes from which tokens may lead on
        out: list[int] = []
        at, token = 0, longest[0]
        while at < len(piece):
            while token is not None and not (open_[at + size[token]] and (not out or known[out[-1], token])):
                token = prefix[token]
            if token is not None:
                out.append(token)
                at += size[token]
                token = longest[at] if at < len(piece) else None
            else:
                open_[at] = 0
                token = out.pop()  # the first byte always leads on
                at -= size[token]
                token = prefix[token]
        return out


def disputed(kind: str) -> list[int]:
    """Code points that the regex package counts in a class such as ``\\p{L}`` and the library's pattern does not."""
    import regex
    import tiktoken

    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    library = tiktoken.Encoding("class", pat_str=kind, mergeable_ranks={bytes([k]): k for k in range(256)}, special_tokens={})
    counted, ours = set(library.decode(library.encode_ordinary(every))), regex.findall(kind, every)
    if counted - set(ours):
        raise ValueError(f"{kind} of the regex package lacks characters")
    return [ord(c) for c in ours if c not in counted]


class ByteTokenizer:
    """Ids of whole texts as the tiktoken library's ``encode_ordinary`` gives them."""

    def __init__(self, path: str, pattern: str):
        import regex

        self.merges = Merges(read_ranks(path))
        self.usual = regex.compile(pattern)
        self.first = 0x110000  # below it there is no dispute
        for kind in (r"\p{L}", r"\p{N}"):
            extra = disputed(kind)
            if extra:
                self.first = min(self.first, extra[0])
                starts = [k for k, c in enumerate(extra) if not k or c != extra[k - 1] + 1]
                spans = "".join(f"\\U{extra[a]:08X}-\\U{extra[b - 1]:08X}" for a, b in zip(starts, [*starts[1:], len(extra)], strict=True))
                pattern = pattern.replace(kind, f"[{kind}--[{spans}]]")
        self.careful = regex.compile(pattern, regex.V1)
        self.pieces: dict[str, bytes] = BoundedCache(self._piece, 300_000)

    def _piece(self, piece: str) -> bytes:
        return np.array(self.merges.encode(piece.encode("utf-8", "surrogatepass")), "<u4").tobytes()

    def blocks(self, text: str) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids, block by block."""
        plain = text.isascii() or int(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").max()) < self.first
        cut = self.usual if plain else self.careful
        if len(text) <= BLOCK:
            parts: Iterator[list[str]] = iter([cut.findall(text)])
        else:
            found = (x.group() for x in cut.finditer(text))
            parts = iter(lambda: list(islice(found, BLOCK)), [])
        pieces, encode = self.pieces, self._piece
        for part in parts:
            yield b"".join([pieces[x] if len(x) <= SHORT else encode(x) for x in part])

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.merges.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def digests(self, text: object) -> tuple[int, str, str]:
        """Number of ids, digest of the ids, digest of what they decode to."""
        n, ids, back = 0, hashlib.sha256(), hashlib.sha256()
        for block in self.blocks(text) if isinstance(text, str) else ():
            n += len(block) // 4
            ids.update(block)
            back.update(self.decode(block))
        return n, ids.hexdigest(), back.hexdigest()


@lru_cache(maxsize=2)
def tokenizer(path: str, pattern: str) -> ByteTokenizer:
    return ByteTokenizer(path, pattern)


def _settings(ranks: str | None, pattern: str | None) -> tuple[str, str]:
    if pattern is None:
        import public_tokenizers

        pattern = public_tokenizers.PATTERN
    return ranks or default_ranks(), pattern


def _with(docs: DataFrame, udf, text_col: str, names: list[str]) -> DataFrame:
    found = boxed(docs).withColumn("_found", udf(F.col(f"_doc.`{text_col}`")))
    kept = [F.col(f"_doc.`{c}`").alias(c) for c in docs.columns if c not in names]
    return found.select(*kept, *[f"_found.{c}" for c in names])


def encoded(docs: DataFrame, text_col: str = "text", ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """``docs`` with ``ids``, an array (in the place of a column of this name, if there)."""
    settings = _settings(ranks, pattern)

    @F.pandas_udf("ids array<int>")
    def udf(texts: pd.Series) -> pd.DataFrame:
        tok = tokenizer(*settings)
        rows = [np.frombuffer(b"".join(tok.blocks(x)), "<i4") if isinstance(x, str) else np.zeros(0, "<i4") for x in texts]
        return pd.DataFrame({"ids": pd.Series(rows, dtype=object)})

    return _with(docs, udf, text_col, ["ids"])


def decoded(docs: DataFrame, ids_col: str = "ids", ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """``docs`` with ``decoded``, the bytes that the ids stand for; null ids give none."""
    settings = _settings(ranks, pattern)

    @F.pandas_udf("decoded binary")
    def udf(rows: pd.Series) -> pd.DataFrame:
        tok = tokenizer(*settings)
        return pd.DataFrame({"decoded": [tok.decode(np.asarray(x, "<u4").tobytes()) if x is not None else b"" for x in rows]})

    return _with(docs, udf, ids_col, ["decoded"])


def digested(docs: DataFrame, text_col: str = "text", ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """``docs`` with ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` of each whole text, there and back."""
    settings = _settings(ranks, pattern)
    names = ["n_tokens", "ids_sha256", "decoded_sha256"]

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def udf(texts: pd.Series) -> pd.DataFrame:
        tok = tokenizer(*settings)
        return pd.DataFrame([tok.digests(x) for x in texts], columns=names)

    return _with(docs, udf, text_col, names)
