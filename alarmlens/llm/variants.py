"""Spelling variants: words one edit apart, found by neighbourhoods over a reduced alphabet.

Every code point is hashed to one of a few symbols, so a word has a reduced word of the same length, and two words that are
one edit apart have reduced words that are at most one edit apart.  The full neighbourhood of a reduced word (itself, every
deletion, replacement and insertion of a symbol) is joined with the reduced words of the vocabulary; what meets is verified
on the words themselves.  A link is asked once, from the side that orders later by (length, code), so that of a
neighbourhood the half that orders before its word goes into the join.

Reduced words are written as one 64-bit number, a polynomial of their symbols; neighbours are sums of a prefix, a symbol and a
suffix of it.

The number of symbols follows the sixth root of the vocabulary, so reduced words stay nearly as many as words while a
neighbourhood stays small.  Two reduced words that stand for more than ``MOST`` pairs of words are not expanded: their words
go to the next level, with four times the symbols, and at last with a symbol for each code point, where a reduced word stands
for one word.  So no group is ever paired with itself unless it is small, and nothing is left out.

Words are counted in the tasks that read the texts (a text is whitened outside of its letters and split), added up across
tasks, and met by name after that.  Roots are found by doubling pointers over words that have a form; a form has at least
twice its word's count, so there are no cycles and the rounds are few.

Defined results: null and empty texts have no words; a null id is written as nothing before the colon; repeated rows count
each; words of any length are taken whole; a table without words that are frequent enough gives no rows.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Letters: ASCII ones and U+00C0 to U+00FF.  One byte each in Latin-1, lower-cased in ASCII alone; all else is a space.
_LETTERS = bytes(c if c >= 0xC0 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
SHORTEST, RAREST, FACTOR = 5, 3, 2
#: Planted misspellings: where the checksum of id and word is a multiple of this.
EVERY = 97
#: Candidate pairs that two reduced words may stand for; distinct words that a task counts at once; characters read at once.
MOST, HELD, CHUNK = 1024, 200_000, 1 << 22


def letters(text: str) -> Iterator[bytes]:
    """The text as lower-case Latin-1 with spaces between its runs of letters, in chunks that end outside of a run."""
    rest = b""
    for k in range(0, len(text), CHUNK):
        part = rest + text[k : k + CHUNK].encode("latin-1", "replace").translate(_LETTERS)
        cut = len(part) if k + CHUNK >= len(text) else part.rfind(b" ") + 1
        yield part[:cut]
        rest = part[cut:]


def occurring(ident: object, text: str, every: int = EVERY) -> Counter:
    """Words of a text with their counts, a code point left out where the checksum of id and run says so."""
    runs: Counter = Counter()
    for part in letters(text):
        runs.update(part.split())
    start = zlib.crc32(f"{'' if ident is None else ident}:".encode())
    words: Counter = Counter()
    for run, n in runs.items():
        h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), start)
        if h % every == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        words[run] += n
    return words


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = SHORTEST, rarest: int = RAREST, every: int = EVERY) -> DataFrame:
    """(word, n): words of at least ``shortest`` code points and ``rarest`` occurrences.  Ids are integers."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter = Counter()

        def told() -> pd.DataFrame:
            # of type object also when there is none: an empty column of numbers is no column of texts
            words = pd.Series([w.decode("latin-1") for w in held], dtype=object)
            return pd.DataFrame({"word": words, "n": np.fromiter(held.values(), np.int64, len(held))})

        for pdf in batches:
            for ident, text in zip(pdf["id"], pdf["text"], strict=True):
                if isinstance(text, str):
                    for word, n in occurring(ident, text, every).items():
                        if len(word) >= shortest:
                            held[word] += n
                    if len(held) > HELD:
                        yield told()
                        held.clear()
        yield told()

    rows = docs.select(F.col(f"`{id_col}`").cast("string").alias("id"), F.col(f"`{text_col}`").alias("text"))
    counted = rows.mapInPandas(count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= rarest)


# ------------------------------------------------------------------ reduced words

#: The code points of words: a to z, U+00C0 to U+00FF.
ALPHABET = bytes([*range(97, 123), *range(0xC0, 0x100)])
#: Odd, so that its powers have inverses; the value is of no account.
_BASE = 0x9E3779B97F4A7C15


def symbol_of(symbols: int) -> np.ndarray:
    """Symbol, from 1, of each byte of a word; with enough symbols each has its own."""
    table = np.zeros(256, np.uint8)
    for k, c in enumerate(ALPHABET):
        table[c] = 1 + (k if symbols >= len(ALPHABET) else zlib.crc32(bytes([c])) % symbols)
    return table


def _powers(n: int) -> np.ndarray:
    return np.multiply.accumulate(np.array([1] + [_BASE] * n, np.uint64))


def codes(shapes: np.ndarray) -> np.ndarray:
    """Number of each row of symbols."""
    return (shapes * _powers(shapes.shape[1])[:-1]).sum(axis=1, dtype=np.uint64)


def _by_length(words: list[bytes], most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Words of one length together: their places and a matrix of their bytes of about ``most`` at most."""
    sizes = np.array([len(w) for w in words], np.int64)
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        step = max(1, most // max(1, int(size)))
        for k in range(0, len(at), step):
            part = at[k : k + step]
            yield part, np.frombuffer(b"".join([words[i] for i in part]), np.uint8).reshape(len(part), size)


def reduced(c: Column, symbols: int) -> Column:
    """(code long, shape string) of words: the reduced word, a character a symbol, and its number."""
    table = symbol_of(symbols)

    @F.pandas_udf("code long, shape string")
    def udf(words: pd.Series) -> pd.DataFrame:
        data = [w.encode("latin-1") for w in words]
        code = np.zeros(len(data), np.uint64)
        for at, rows in _by_length(data):
            code[at] = codes(table[rows])
        return pd.DataFrame({"code": code.view(np.int64), "shape": [w.translate(table.tobytes()).decode("latin-1") for w in data]})

    return udf(c)


def neighbours(shapes: np.ndarray, symbols: int, insertions: bool = True, most: int = 1 << 20) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """Kind, row numbers and codes of all that is at most one edit from each row of ``shapes``, each once, in parts of about
    ``most``: the row ("same"), "deleted", "replaced" and "inserted"."""
    n, size = shapes.shape
    power, symbol = _powers(size + 1), np.arange(1, symbols + 1, dtype=np.uint64)
    inverse, base = np.uint64(pow(_BASE, -1, 1 << 64)), np.uint64(_BASE)
    term = shapes * power[:size]
    before = np.zeros((n, size + 1), np.uint64)  # of what comes before each place
    np.cumsum(term, axis=1, out=before[:, 1:])
    whole = before[:, -1:]
    yield "same", np.arange(n), whole[:, 0]
    beyond = np.concatenate([shapes, np.zeros((n, 1), shapes.dtype)], axis=1)
    places = max(1, most // max(1, n * symbols))
    for k in range(0, size + 1, places):
        span = np.arange(k, min(k + places, size + 1))
        inner = span[span < size]
        # of a run of one symbol only the last is left out: what follows moves up
        left = (whole - before[:, inner + 1]) * inverse + before[:, inner]
        row, at = np.nonzero(beyond[:, inner] != beyond[:, inner + 1])
        yield "deleted", row, left[row, at]
        changed = (whole - term[:, inner])[:, :, None] + power[inner][None, :, None] * symbol
        row, at, new = np.nonzero(beyond[:, inner, None] != symbol)
        yield "replaced", row, changed[row, at, new]
        if insertions:  # of a run of one symbol only the end grows: what follows moves down
            moved = before[:, span] + (whole - before[:, span]) * base
            grown = moved[:, :, None] + power[span][None, :, None] * symbol
            row, at, new = np.nonzero(beyond[:, span, None] != symbol)
            yield "inserted", row, grown[row, at, new]


def _asked(classes: DataFrame, symbols: int) -> DataFrame:
    """(code, key) of ``classes`` (code, shape): of the neighbourhood of each reduced word itself and what orders before it,
    by length and code.  Insertions are longer and would all go: they are the deletions of the other side."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            own = pdf["code"].to_numpy(np.int64)
            for at, shapes in _by_length([w.encode("latin-1") for w in pdf["shape"]], 1 << 17):
                for kind, row, key in neighbours(shapes, symbols, insertions=False):
                    code, key = own[at[row]], key.view(np.int64)
                    keep = key < code if kind == "replaced" else slice(None)
                    yield pd.DataFrame({"code": code[keep], "key": key[keep]})

    return classes.mapInPandas(make, "code long, key long")


def _symbols(words: int) -> int:
    """The least number of symbols, at least 4, whose sixth power reaches the number of words."""
    return min(len(ALPHABET), max(4, int(np.ceil(max(1, words) ** (1 / 6)))))


def near_pairs(words: DataFrame, symbols: int | None = None, most: int = MOST) -> DataFrame:
    """(a, n_a, b, n_b) of ``words`` (word, n; stored, distinct) that differ by exactly one inserted, deleted or replaced
    code point, each link once."""
    symbols = symbols or _symbols(words.count())
    found: list[DataFrame] = []
    while True:
        last = symbols >= len(ALPHABET)
        coded = materialize(words.withColumn("_r", reduced(F.col("word"), symbols)).select("word", "n", "_r.*"), "coded")
        sized = coded.groupBy("code").agg(F.count("*").alias("m"))
        asked = _asked(coded.select("code", "shape").distinct(), symbols)
        links = asked.join(sized.select(F.col("code").alias("key"), F.col("m").alias("m_key")), "key").join(sized, "code")
        links = materialize(links.filter((F.col("code") != F.col("key")) | (F.col("m") > 1)), "links")
        large = (F.col("m") * F.col("m_key") > most) & F.lit(not last)
        own = coded.select("code", F.col("word").alias("a"), F.col("n").alias("n_a"))
        other = coded.select(F.col("code").alias("key"), F.col("word").alias("b"), F.col("n").alias("n_b"))
        met = links.filter(~large).select("code", "key").join(own, "code").join(other, "key")
        once = (F.col("code") != F.col("key")) | (F.col("a") < F.col("b"))
        found.append(met.filter(once & (F.levenshtein("a", "b", 1) == 1)).select("a", "n_a", "b", "n_b"))
        hot = links.filter(large)
        if last or hot.isEmpty():
            break
        again = hot.select(F.explode(F.array("code", "key")).alias("code")).distinct()
        words = materialize(coded.join(again, "code", "left_semi").select("word", "n"), "hot-words")
        symbols *= 4
    pairs = reduce(DataFrame.unionByName, found)
    if len(found) > 1:  # words of large classes may have met others before
        x, y = F.struct(F.col("a").alias("w"), F.col("n_a").alias("n")), F.struct(F.col("b").alias("w"), F.col("n_b").alias("n"))
        pairs = pairs.select(F.least(x, y).alias("x"), F.greatest(x, y).alias("y")).distinct()
        pairs = pairs.select(F.col("x.w").alias("a"), F.col("x.n").alias("n_a"), F.col("y.w").alias("b"), F.col("y.n").alias("n_b"))
    return pairs


def grouped(words: DataFrame, factor: int = FACTOR) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of ``words`` (word, n)."""
    words = materialize(words, "words")
    pairs = near_pairs(words)
    side = lambda x, y: F.struct(F.col(x).alias("word"), F.col(y).alias("near"), F.col(f"n_{y}").alias("m"))
    both = pairs.select(F.inline(F.array(side("a", "b"), side("b", "a"))))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("less"), "near")).alias("best"))
    rows = words.join(best, "word", "left")
    strong = -F.col("best.less") >= factor * F.col("n")
    rows = rows.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(strong, F.col("best.near")).alias("form"), F.when(strong, -F.col("best.less")).alias("form_n"))
    rows = materialize(rows, "forms")
    up = materialize(rows.filter("form IS NOT NULL").select("word", F.col("form").alias("root")), "up")
    while True:  # after k rounds a pointer has gone 2^k steps or is at its root
        on = up.select(F.col("word").alias("root"), F.col("root").alias("further"))
        met = materialize(up.join(on, "root", "left"), "up")
        if met.filter("further IS NOT NULL").isEmpty():
            break
        up = met.select("word", F.coalesce("further", "root").alias("root"))
    return rows.join(up, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of the words of whole texts."""
    return grouped(vocabulary(docs, id_col, text_col))
