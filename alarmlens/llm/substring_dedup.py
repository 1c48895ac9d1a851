"""Removal of word passages that occur more than once, by level-wise doubling.

Level 1 looks at windows of a quarter of the length (9 words for 35), level 2 at windows of twice as many words (18), the
last at the whole length, which cuts the last doubling short.  Windows repeated at one length alone are extended to twice
that length, until no candidates survive or the whole length is reached.

A level need not ship every short window: each whole window is represented by the short window with the least hash
inside it (the last such, if equal), its anchor, which is the same wherever the whole window occurs; so a whole window can
only repeat if its anchor does.  The stretch of text whose whole windows share an anchor (its segment) is one row.  Anchors
that occur once end there.  Where all segments of an anchor are equal, all its windows repeat, and this is settled at that
level.  The windows of anchors with differing segments go on to the next level, and at the whole length they are counted one
by one.

Hashes: a window is identified by its anchor's and its own 64-bit hash together, or a segment's.  All steps are grouped
counts (combined before the shuffle) and joins on hashes; counts are stored before they are joined, so that Spark may
split the other side where a passage is very common.

Row numbers are stored with the texts once, and everything is joined on that stored copy, so results do not depend on how
a scan is split.

Defined results: null text has no words; texts shorter than the window keep everything; repeated rows are documents of
their own, so their windows repeat; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BoundedCache, as_bytes, boxed, materialize, numbered, settled, text_chunks

WINDOW = 35
BASE = 0x9E3779B97F4A7C15
_words: BoundedCache = BoundedCache(lambda w: xxhash.xxh3_64_intdigest(w), 500_000)


def _power(n: int) -> np.uint64:
    return np.uint64(pow(BASE, n, 1 << 64))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Polynomial hash of the ``n`` words from each place on, by doubling; places too near the end are left out."""
    out, have, power, span = None, 0, words, 1
    while n:
        if n & 1:
            if out is None:
                out, have = power, span
            else:
                m = max(0, min(len(out), len(power) - have))
                out, have = out[:m] * _power(span) + power[have : have + m], have + span
        n >>= 1
        if n:
            m = max(0, len(power) - span)
            power, span = power[:m] * _power(span) + power[span : span + m], span * 2
    return out


def level_lengths(window: int, least: int = 9) -> list[int]:
    """Lengths of the levels below the whole window, each twice the one before."""
    lengths = [max(1, min(least, window // 2))]
    while 2 * lengths[-1] < window:
        lengths.append(2 * lengths[-1])
    return lengths


def _places(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first, first + 1, ... (count of them) for each, end to end."""
    return np.repeat(first, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)


class Texts:
    """The words of some texts, end to end, with what the levels need of them."""

    PLACE_BITS = 28

    def __init__(self, texts: pd.Series, window: int):
        self.window = window
        split = [as_bytes(x).split() for x in texts]
        self.lengths = np.array([len(w) for w in split], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])
        total = int(self.starts[-1])
        self.words = np.fromiter(map(_words.__getitem__, chain.from_iterable(split)), np.uint64, total)
        self.doc = np.repeat(np.arange(len(split)), self.lengths)

    def all_windows(self) -> np.ndarray:
        """Places where a whole window starts."""
        at = np.arange(len(self.doc))
        return at[at + self.window <= self.starts[1:][self.doc]]

    def windows_of(self, spans: pd.Series) -> np.ndarray:
        """Places of the whole windows in the spans (packed) of each text."""
        packed = [np.sort(np.asarray(x, np.int64)) for x in spans]
        span = np.concatenate(packed) if packed else np.zeros(0, np.int64)
        begin = np.repeat(self.starts[:-1], [len(x) for x in packed])
        return _places(begin + (span >> 32), (span & 0xFFFFFFFF) + 1)

    def segments(self, windows: np.ndarray, n: int) -> pd.DataFrame:
        """One row for each stretch of ``windows`` with one anchor of ``n`` words: text, span (first window and number of
        further ones, packed), anchor, hash of the whole stretch."""
        if not len(windows):
            return pd.DataFrame({"text": [], "span": [], "anchor": [], "segment": []}).astype("int64")
        mixed = _mix(gram_hashes(self.words, n))
        # least hash, then last place, over the places of a window's short windows, by doubling
        last_place = np.uint64((1 << self.PLACE_BITS) - 1)
        low = (mixed & ~last_place) | (last_place - np.arange(len(mixed), dtype=np.uint64))
        have, span = 1, self.window - n + 1
        while have < span:
            step = min(have, span - have)
            low = np.minimum(low[: len(low) - step], low[step:])
            have += step
        anchor = (last_place - (low[windows] & last_place)).astype(np.int64)
        doc = self.doc[windows]
        new = np.ones(len(anchor), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (windows[1:] != windows[:-1] + 1) | (doc[1:] != doc[:-1])
        lo = np.flatnonzero(new)
        hi = np.append(lo[1:], len(anchor)) - 1
        full = _mix(gram_hashes(self.words, self.window))
        # equal first and last windows, equal distances to the anchor: equal stretches
        first, last, place = windows[lo], windows[hi], anchor[lo]
        segment = _mix(full[first] * _power(1) + full[last] * _power(2) + ((place - first) * 1009 + (last - first)).astype(np.uint64) * _power(3))
        return pd.DataFrame({
            "text": doc[lo], "span": ((first - self.starts[doc[lo]]) << 32) | (last - first),
            "anchor": mixed[place].view(np.int64), "segment": segment.view(np.int64),
        })

    def window_hashes(self) -> np.ndarray:
        return _mix(gram_hashes(self.words, self.window) ^ np.uint64(BASE))


def repeated_windows(keyed: DataFrame, text: Column, window: int = WINDOW) -> DataFrame:
    """``keyed`` (with ``_row``, a written table): (_row, runs) of the documents with repeated windows; runs: array of the
    first and last window start (word places) of stretches of repeated windows."""
    texts = keyed.select("_row", text.alias("text"))
    shape = "_row long, span long, anchor long, segment long"
    repeats: list[DataFrame] = []
    survivors = None
    for n in level_lengths(window):
        rows = texts if survivors is None else texts.join(survivors.groupBy("_row").agg(F.collect_list("span").alias("spans")), "_row")

        def scan(batches: Iterator[pd.DataFrame], n: int = n) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for pdf in text_chunks(batch, "text"):
                    t = Texts(pdf["text"], window)
                    found = t.segments(t.windows_of(pdf["spans"]) if "spans" in pdf else t.all_windows(), n)
                    yield pd.DataFrame({"_row": pdf["_row"].to_numpy()[found["text"].to_numpy()], **{c: found[c] for c in ("span", "anchor", "segment")}})

        level = materialize(rows.mapInPandas(scan, shape), f"level-{n}")
        counted = level.groupBy("anchor").agg(F.count("*").alias("n"), (F.min("segment") == F.max("segment")).alias("alike"))
        counted = materialize(counted.filter("n > 1").select("anchor", "alike"), f"repeated-{n}")
        level = materialize(level.join(counted, "anchor").select("_row", "span", "anchor", "alike"), f"candidates-{n}")
        repeats.append(level.filter("alike").select("_row", F.shiftright("span", 32).alias("first"), (F.shiftright("span", 32) + F.col("span").bitwiseAND(0xFFFFFFFF)).alias("last")))
        survivors = level.filter("not alike").select("_row", "span", "anchor")
        if survivors.isEmpty():
            break
    else:
        # the whole length: the windows of repeated anchors whose segments differ, one by one
        def extend(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for pdf in text_chunks(batch, "text"):
                    t = Texts(pdf["text"], window)
                    hashes = t.window_hashes()
                    out = []
                    for row, start, spans in zip(pdf["_row"].to_numpy(), t.starts, pdf["spans"], strict=False):
                        span = np.array([x["span"] for x in spans], np.int64)
                        count = (span & 0xFFFFFFFF) + 1
                        place = _places(span >> 32, count)
                        out.append((np.full(len(place), row), np.repeat(np.array([x["anchor"] for x in spans], np.int64), count), hashes[start + place].view(np.int64), place))
                    yield pd.DataFrame(dict(zip(("_row", "anchor", "hash", "place"), map(np.concatenate, zip(*out, strict=True)), strict=True)))

        wanted = survivors.groupBy("_row").agg(F.collect_list(F.struct("span", "anchor")).alias("spans"))
        whole = materialize(texts.join(wanted, "_row").mapInPandas(extend, "_row long, anchor long, hash long, place long"), "windows")
        twice = materialize(whole.groupBy("anchor", "hash").agg(F.count("*").alias("n")).filter("n > 1").select("anchor", "hash"), "repeated-windows")
        repeats.append(whole.join(twice, ["anchor", "hash"], "left_semi").select("_row", F.col("place").alias("first"), F.col("place").alias("last")))
    return reduce(DataFrame.unionByName, repeats).groupBy("_row").agg(F.collect_list(F.struct("first", "last")).alias("runs"))


def _kept(texts: pd.Series, runs: pd.Series, window: int) -> Iterator[tuple[list[bytes], list[bytes]]]:
    """Words and kept words of each text."""
    for text, found in zip(texts, runs, strict=True):
        words = as_bytes(text).split()
        if found is None or not len(found):
            yield words, words
            continue
        edge = np.zeros(len(words) + 1, np.int64)
        np.add.at(edge, [x["first"] for x in found], 1)
        np.add.at(edge, [x["last"] + window for x in found], -1)
        keep = np.cumsum(edge)[:-1] == 0
        yield words, [w for w, k in zip(words, keep.tolist(), strict=True) if k]


def dedup_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Per document: id, n_words, n_removed, kept_sha256."""
    keyed = numbered(docs.select(F.col(id_col), F.col(text_col)), "texts")
    runs = settled(docs.sparkSession, "runs", lambda: repeated_windows(keyed, F.col(text_col), window))

    @F.pandas_udf("n_words long, n_removed long, kept_sha256 string")
    def digest(texts: pd.Series, found: pd.Series) -> pd.DataFrame:
        rows = [(len(w), len(w) - len(k), hashlib.sha256(b" ".join(k)).hexdigest()) for w, k in _kept(texts, found, window)]
        return pd.DataFrame(rows, columns=["n_words", "n_removed", "kept_sha256"])

    return keyed.join(runs, "_row", "left").select(id_col, digest(text_col, "runs").alias("d")).select(id_col, "d.*")


def without_repeats(docs: DataFrame, text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` with repeated passages removed from the text (kept words joined by one space; a text that loses nothing
    stays as it is, null too).  ``n_chars``, if there, follows the new text."""
    keyed = numbered(boxed(docs), "texts")
    text = F.col(f"_doc.`{text_col}`")
    runs = settled(docs.sparkSession, "runs", lambda: repeated_windows(keyed, text, window))

    @F.pandas_udf("string")
    def cleaned(texts: pd.Series, found: pd.Series) -> pd.Series:
        return pd.Series([
            text if len(k) == len(w) else b" ".join(k).decode("utf-8", "surrogatepass") for text, (w, k) in zip(texts, _kept(texts, found, window), strict=True)
        ], dtype=object)

    kept = F.col("runs").isNull()
    rows = keyed.join(runs, "_row", "left").withColumn("_new", F.when(kept, text).otherwise(cleaned(text, F.col("runs"))))
    out = {c: F.col(f"_doc.`{c}`") for c in docs.columns} | {text_col: F.col("_new")}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.when(kept, F.col("_doc.n_chars")).otherwise(F.length("_new").cast(docs.schema["n_chars"].dataType))
    return rows.select(*[x.alias(c) for c, x in out.items()])
