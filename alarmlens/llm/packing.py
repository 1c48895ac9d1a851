"""Best-fit packing of tokenised documents into sequences, in bulk-synchronous rounds.

Pieces and gaps (the free ends of open sequences) are sorted by size.  One sweep finds for every gap the largest piece
that fits and no other gap has a better claim to: walking the sizes upwards, a piece steps one level up and a gap one
level down, and a gap takes the piece whose level it closes.  Levels are ranks: the histogram by size, which the driver has,
gives each class its first level, and a row's rank within its class (dealt into buckets where it is large) the rest, so a
sweep is one window over each class and one over each level (at most two rows of a size meet in a level, so no window
exceeds twice the capacity): two shuffles.  Gaps shrink by what they took
and the next round starts.

Before a round as many sequences are opened as the sum of what waits asks for beyond the gaps there are, one for each of the
longest pieces (every piece of more than half a sequence opens its own); if a sweep finds nothing, gaps do not count.  All
other pieces are placed by sweeps.  Short pieces of one size go together as a unit of at most a thirty-second part of a sequence, which
is placed like a piece, so that a gap is filled in few rounds.  What a round places is added to one table in the shared
folder.  The driver sees one row for each size.

Ids: every token lies within a run without white space, so runs are looked up by themselves (a bounded cache).  Runs that
are new are split by the file's own pattern and looked up piece by piece in the library's model, if all their characters
are ones that the library was seen to treat one by one; all others go through the library's ``encode`` as they are.

Defined results: null text counts as empty and is one token (the separator); repeated rows are packed once each; an
empty table gives no rows.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import BoundedCache, append, as_bytes, materialize, numbered, scratch_path, settled

CAPACITY = 2048
#: So many rows of one size are picked by their ids.
EXACT = 1000
SEPARATOR = 0


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordTokenizer:
    """Ids as ``Tokenizer.from_file(path).encode(text, add_special_tokens=False)`` gives them; strings of special tokens
    in a text are special tokens."""

    #: Characters below this are looked at one by one; there are no combining ones among them.
    SIMPLE = 0x250

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        self.split = regex.compile(next(x["pattern"]["Regex"] for x in told["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")).findall
        # what the library makes of each simple character: its normal form, its kind, its bytes' names
        normal, level = self.tokenizer.normalizer.normalize_str, self.tokenizer.pre_tokenizer.pre_tokenize_str
        self.normal: dict[int, str] = {}
        self.level: dict[int, str] = {}
        for code in range(self.SIMPLE):
            c = normal(chr(code))
            pieces = [x for x, _ in level(c)]
            alike = len(c) == 1 and all([len(level(t)) == len(self.split(t)) for t in (c, c + c, c + "a", "a" + c, c + "1", c + ".")])
            if alike and len(pieces) < 2:
                self.normal[code] = c
                self.level[ord(c)] = "".join(pieces)
        simple = "".join(map(re.escape, map(chr, self.normal)))
        self.unusual = re.compile("|".join([f"[^{simple}]", *(re.escape(x["content"]) for x in told["added_tokens"])])).search
        self.pieces = BoundedCache(self._piece, 300_000)
        self.runs = BoundedCache(self._run, 400_000)

    def _piece(self, s: str) -> bytes:
        return np.array([t.id for t in self.model.tokenize(s.translate(self.level))], "<u4").tobytes()

    def _run(self, run: bytes) -> bytes:
        s = run.decode("utf-8", "replace")
        if self.unusual(s):
            return np.array(self.tokenizer.encode(s, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join([self.pieces[x] for x in self.split(s.translate(self.normal))])

    def ids(self, data: bytes) -> bytes:
        """Little-endian unsigned 32-bit ids of UTF-8 ``data``."""
        return b"".join(map(self.runs.__getitem__, data.split()))


@lru_cache(maxsize=2)
def _tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def tokenized_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """One row per piece: ``id``, piece, start, length, ids_crc32.  Each document ends with the separator id; only longer
    documents than ``capacity`` are cut."""
    path = tokenizer or default_tokenizer()
    end = np.array([SEPARATOR], "<u4").tobytes()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tok = _tokenizer(path)
        for pdf in batches:
            rows, crcs = [], []
            for at, text in enumerate(pdf["text"]):
                ids = tok.ids(as_bytes(text)) + end
                for k in range(0, len(ids), 4 * capacity):
                    part = ids[k : k + 4 * capacity]
                    rows.append((at, k // (4 * capacity), k // 4, len(part) // 4))
                    crcs.append(zlib.crc32(part))
            at, piece, start, length = np.array(rows, np.int64).reshape(-1, 4).T
            yield pd.DataFrame({"id": pdf["id"].take(at).array, "piece": piece.astype(np.int32), "start": start, "length": length, "ids_crc32": crcs})

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    found = rows.mapInPandas(cut, f"id {kind}, piece int, start long, length long, ids_crc32 long")
    return found


def _classes(sizes: dict[int, int], free: dict[int, int], rows_per_bucket: int) -> list[tuple[int, bool, int, int]]:
    """(size, is_gap, base, buckets) of each class, ``sizes`` being the pieces and ``free`` the gaps (size: rows): the level
    that its rows start from, and into how many parts they are dealt.  Two classes a size at most."""
    found, level = [], 0
    for size, is_gap in sorted([(x, False) for x in sizes] + [(x, True) for x in free]):
        n = (free if is_gap else sizes)[size]
        found.append((size, is_gap, level, -(-n // rows_per_bucket)))
        level += -n if is_gap else n
    return found


def _sweep(rows: DataFrame, classes: list[tuple[int, bool, int, int]]) -> DataFrame:
    """``rows``: (id, size, is_gap), ``classes``: theirs.  Adds ``mate``, ``mate_size``: of a piece the gap that takes it and
    that gap's size, of a gap the piece that it takes and that piece's length."""
    of_class = ["size", "is_gap"]
    columns = zip(*classes, strict=True) if classes else [[]] * 4
    kinds = (("size", pa.int64()), ("is_gap", pa.bool_()), ("base", pa.int64()), ("buckets", pa.int64()))
    told = rows.sparkSession.createDataFrame(pa.table({name: pa.array(x, kind) for (name, kind), x in zip(kinds, columns, strict=True)}))
    rows = rows.join(F.broadcast(told), of_class).withColumn("bucket", F.pmod(F.xxhash64("id"), F.col("buckets")))
    rank = F.row_number().over(W.partitionBy(*of_class, "bucket").orderBy("id"))
    ranked = rows.withColumn("rank", rank.cast("long"))
    if any(buckets > 1 for *_, buckets in classes):  # else a class is one bucket, and ranks in it are ranks in the class
        counts = ranked.filter("buckets > 1").groupBy(*of_class, "bucket").agg(F.max("rank").alias("n"))
        before = W.partitionBy(*of_class).orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
        first = counts.select(*of_class, "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("in_class"))
        ranked = ranked.join(first, [*of_class, "bucket"], "left").withColumn("rank", F.col("rank") + F.coalesce("in_class", F.lit(0)))
    level = F.when(F.col("is_gap"), F.col("base") - F.col("rank") + 1).otherwise(F.col("base") + F.col("rank"))
    levelled = ranked.select("id", "size", "is_gap", level.alias("level"))
    across = W.partitionBy("level").orderBy("size", "is_gap")
    after, prior = (f(F.struct("id", "size", "is_gap"), 1).over(across) for f in (F.lead, F.lag))
    swept = levelled.select("id", "size", "is_gap", after.alias("after"), prior.alias("prior"))
    mate = F.when(F.col("is_gap") & ~F.col("prior.is_gap"), F.col("prior")).when(~F.col("is_gap") & F.col("after.is_gap"), F.col("after"))
    return swept.select("id", "size", "is_gap", mate["id"].alias("mate"), mate["size"].alias("mate_size"))


def _units(pieces: DataFrame, most: int, buckets: int) -> DataFrame:
    """``pieces`` (id, size), stored, with the unit that each is placed with: ``lead`` (the least id of the unit), ``inner``
    (the place in it) and ``total`` (its size).  A unit is one piece, or short ones of one size up to ``most`` together."""
    together = F.greatest(F.lit(1), F.floor(F.lit(most) / F.col("size")))
    rows = pieces.withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(buckets)))
    rows = rows.withColumn("rank", F.row_number().over(W.partitionBy("size", "bucket").orderBy("id")) - 1)
    rows = rows.withColumn("unit", F.floor(F.col("rank") / together))
    unit = W.partitionBy("size", "bucket", "unit")
    inner = (F.col("rank") % together) * F.col("size")
    return materialize(rows.select("id", F.min("id").over(unit).alias("lead"), inner.cast("long").alias("inner"), F.sum("size").over(unit).alias("total")), "units")


def longest(sizes: dict[int, int], wanted: int) -> tuple[int, int]:
    """(s, n): of rows with these ``sizes`` (size: rows) the ``wanted`` longest are those above s and n of those of size s."""
    for size in sorted(sizes, reverse=True):
        if sizes[size] >= wanted:
            return size, wanted
        wanted -= sizes[size]
    return 0, 0


def _openers(left: DataFrame, sizes: dict[int, int], wanted: int) -> tuple[Column, dict[int, int]]:
    """Which rows of ``left`` are the ``wanted`` longest, or a few less where very many of one size are as good; and how many
    they are of each size."""
    size, n = longest(sizes, wanted)
    opened = {s: m for s, m in sizes.items() if s > size or s == size and m == n}
    if n == sizes.get(size, 0):
        return F.col("size") >= size, opened
    same = left.filter(F.col("size") == size)
    if n <= EXACT:
        some = F.col("id") <= same.orderBy("id").limit(n).agg(F.max("id")).first()[0]
    else:
        some = F.pmod(F.xxhash64(F.lit(wanted), "id"), F.lit(1 << 30)) < int((n - 2 * n**0.5) / sizes[size] * (1 << 30))
        n = same.filter(some).count()
    return (F.col("size") > size) | ((F.col("size") == size) & some), opened | ({size: n} if n else {})


def pack(pieces: DataFrame, capacity: int = CAPACITY, rows_per_bucket: int = 500_000) -> DataFrame:
    """Place ``pieces`` (id long, unique; size long from 1 to ``capacity``): one row each (id, sequence_id, offset)."""
    spark, path = pieces.sparkSession, scratch_path(pieces.sparkSession, "placed")
    buckets = max(16, pieces.count() // rows_per_bucket)
    members = _units(pieces, capacity // 32, buckets)
    left = members.filter("id = lead").select("id", F.col("total").alias("size"))
    gaps = left.limit(0)
    sizes = dict(left.groupBy("size").count().collect())  # a row a size
    append(gaps.select("id", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset")), path)  # there even for no pieces
    free: dict[int, int] = {}
    found = 0
    while sizes:
        # open as many sequences as the sum asks for: with what has more than half a sequence, or if nothing fits, all anew
        large, weight = sum(n for size, n in sizes.items() if 2 * size > capacity), sum(size * n for size, n in sizes.items())
        room = sum(size * n for size, n in free.items() if size >= min(sizes)) if found or not free else 0
        wanted = max(large, -(-(weight - room) // capacity))
        if wanted > 0:
            opens, many = _openers(left, sizes, wanted)
            opened = left.filter(opens)
            append(opened.select("id", F.col("id").alias("sequence_id"), F.lit(0).cast("long").alias("offset")), path)
            gaps = gaps.unionByName(opened.select("id", (F.lit(capacity) - F.col("size")).alias("size")).filter("size > 0"))
            left = left.filter(~opens)
            for size, n in many.items():
                free[capacity - size] = free.get(capacity - size, 0) + n
            sizes = {size: n - many.get(size, 0) for size, n in sizes.items() if n > many.get(size, 0)}
            if not sizes:
                break
        fit, free = gaps.filter(F.col("size") >= min(sizes)), {size: n for size, n in free.items() if size >= min(sizes)}
        both = left.withColumn("is_gap", F.lit(False)).unionByName(fit.withColumn("is_gap", F.lit(True)))
        swept = materialize(_sweep(both, _classes(sizes, free, rows_per_bucket)), "sweep")
        got = swept.filter("not is_gap and mate is not null")
        append(got.select("id", F.col("mate").alias("sequence_id"), (F.lit(capacity) - F.col("mate_size")).cast("long").alias("offset")), path)
        left = swept.filter("not is_gap and mate is null").select("id", "size")
        gaps = swept.filter("is_gap").select("id", (F.col("size") - F.coalesce("mate_size", F.lit(0))).alias("size")).filter("size > 0")
        # a row a size of gaps, of pieces that are placed and of such that wait
        kind = F.when(F.col("is_gap"), "gap").when(F.col("mate").isNull(), "waits").otherwise("placed")
        after = F.when(F.col("is_gap"), F.col("size") - F.coalesce("mate_size", F.lit(0))).otherwise(F.col("size"))
        counts = swept.groupBy(kind.alias("kind"), after.alias("size")).count().collect()
        sizes, free = ({r["size"]: r["count"] for r in counts if r["kind"] == k} for k in ("waits", "gap"))
        found = sum(r["count"] for r in counts if r["kind"] == "placed")
    placed = spark.read.schema("id long, sequence_id long, offset long").parquet(path)
    return members.join(placed.withColumnRenamed("id", "lead"), "lead").select("id", "sequence_id", (F.col("offset") + F.col("inner")).alias("offset"))


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """Tokenise and pack: id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = numbered(tokenized_pieces(docs, id_col, text_col, capacity, tokenizer), "pieces", "_piece")
    sized = pieces.select(F.col("_piece").alias("id"), F.col("length").alias("size"))
    places = settled(docs.sparkSession, "places", lambda: pack(sized, capacity)).withColumnRenamed("id", "_piece")
    return pieces.join(places, "_piece").select(F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
