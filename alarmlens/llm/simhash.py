"""SimHash near-duplicate classes by a self-join of binary tries.

Method: every document gets a 64-bit fingerprint.  Distinct fingerprints are dealt four times, once for each block of
16 bits, rotated so that this block leads (two fingerprints with at most three differing bits agree in one block).
All that share a leading block form a subtree of a binary trie.  A subtree is joined with itself by walking pairs of nodes
together, one bit a step, adding up differing bits and dropping a pair as soon as it exceeds the budget; a pair ends where
both nodes hold one fingerprint.

A subtree that is too large for a task is not given to one: it is taken apart into pairs of its nodes a few bits further
down, within the same budget, and so on until every pair of nodes is small (``node_pairs``).  So the upper part of a walk
runs as Spark joins and the lower part in tasks.  Tasks report spanning stars of what they find; a star-contraction loop
over these edges gives the components.

Row numbers are stored with the fingerprints (or documents) once, and everything is joined on that stored copy.

Defined results: null text counts as empty; a text without words has fingerprint zero and links like any other; texts of
fewer words than a shingle are one shingle; repeated rows keep their own result rows; a null id never names a component
unless the component has no other; an empty table gives no rows.  No group of equal fingerprints ever meets in a task:
copies are counted before the join.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_bytes, boxed, materialize, numbered, settled

BITS, BLOCK, BUDGET = 64, 16, 3
SEED = 42


def fingerprint(data: bytes, shingle: int = 3) -> int:
    """Unsigned SimHash of lower-cased (A-Z) words; bit i is set if over half the shingles' hashes have it."""
    words = data.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    hash64 = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return hash64(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = len(words) - shingle + 1
    hashes = np.array(
        [hash64(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[shingle - 1 :].tolist(), strict=True)], np.uint64
    )
    ones = np.unpackbits(hashes.view(np.uint8).reshape(n, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, text_col: str = "text", shingle: int = 3, out: str = "fingerprint") -> DataFrame:
    """``docs`` with a signed 64-bit fingerprint column."""

    @F.pandas_udf(T.LongType())
    def udf(texts: pd.Series) -> pd.Series:
        values = np.array([fingerprint(as_bytes(x), shingle) for x in texts], np.uint64)
        return pd.Series(values.view(np.int64))

    return docs.withColumn(out, udf(F.col(text_col)))


def _split(x: np.ndarray, lo: np.ndarray, hi: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """First place in each sorted range [lo, hi) whose bit ``depth`` (0 leads) is set."""
    bit = (63 - depth).astype(np.uint64)
    a, b = lo.copy(), hi.copy()
    while True:
        live = a < b
        if not live.any():
            return a
        mid = (a + b) >> 1
        one = ((x[np.minimum(mid, len(x) - 1)] >> bit) & np.uint64(1)).astype(bool)
        b = np.where(live & one, mid, b)
        a = np.where(live & ~one, mid + 1, a)


def _hook(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Union by least index, in place."""
    while len(i):
        a, b = root[i], root[j]
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root[:] = up


def trie_links(x: np.ndarray, pairs: list[np.ndarray], depth: np.ndarray, budget: int = BUDGET, wide: int = 100_000) -> tuple[np.ndarray, int]:
    """Component root (least index) of each of ``x`` under links of at most ``budget`` bits, and the number of node pairs
    walked.

    ``x``: values sorted within each node; ``pairs``: arrays alo, ahi, blo, bhi, err of node pairs to start from (a node
    with itself: alo == blo) and ``depth``, the bit to walk on from.  Frontiers wider than ``wide`` are walked depth
    first, which bounds memory.
    """
    root = np.arange(len(x))
    walked = 0
    stack = [(*pairs, depth)]
    while stack:
        frontier = stack.pop()
        if len(frontier[0]) > wide:
            half = len(frontier[0]) // 2
            stack += [tuple(v[half:] for v in frontier), tuple(v[:half] for v in frontier)]
            continue
        alo, ahi, blo, bhi, err, depth = frontier
        walked += len(alo)
        leaf = (ahi - alo == 1) & (bhi - blo == 1)
        i, j = alo[leaf], blo[leaf]
        near = (i != j) & (np.bitwise_count(x[i] ^ x[j]) <= budget)
        _hook(root, i[near], j[near])
        alo, ahi, blo, bhi, err, depth = (v[~leaf] for v in frontier)
        if not len(alo):
            continue
        am, bm = _split(x, alo, ahi, depth), _split(x, blo, bhi, depth)
        own = alo == blo
        other = tuple(v[~own] for v in (am, ahi, blo, bm, err + 1, depth + 1))
        grown = [
            np.concatenate(v)
            for v in zip(
                (alo, am, blo, bm, err, depth + 1),
                (am, ahi, bm, bhi, err, depth + 1),
                (alo, am, bm, bhi, err + 1, depth + 1),
                other,
                strict=True,
            )
        ]
        keep = (grown[0] < grown[1]) & (grown[2] < grown[3]) & (grown[4] <= budget)
        keep &= ~((grown[0] == grown[2]) & (grown[1] - grown[0] == 1))  # a fingerprint with itself
        if keep.any():
            stack.append(tuple(v[keep] for v in grown))
    return root, walked


def _links_of_groups(pdf: pd.DataFrame) -> pd.DataFrame:
    """Spanning stars of whole node pairs (block, depth, p, q)."""
    value = pdf["rotated"].to_numpy().view(np.uint64)
    block, depth, p, q = (pdf[c].to_numpy() for c in PAIR)
    side = (p != q) & (np.right_shift(value, (64 - depth).astype(np.uint64)) == q.view(np.uint64))
    order = np.lexsort((value, side, q, p, depth, block))
    value, side, block, depth, p, q = (v[order] for v in (value, side, block, depth, p, q))
    new = np.ones(len(value), bool)
    new[1:] = (block[1:] != block[:-1]) | (depth[1:] != depth[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1])
    lo = np.flatnonzero(new)
    hi = np.append(lo[1:], len(value))
    own = p[lo] == q[lo]
    cut = np.where(own, hi, hi - np.add.reduceat(side.astype(np.int64), lo) if len(lo) else hi)
    pairs = [lo, cut, np.where(own, lo, cut), hi, np.bitwise_count(p[lo].view(np.uint64) ^ q[lo].view(np.uint64)).astype(np.int64)]
    keep = (pairs[0] < pairs[1]) & (pairs[2] < pairs[3])
    root, _ = trie_links(value, [v[keep] for v in pairs], depth[lo][keep].astype(np.int64))
    shift = (block * BLOCK).astype(np.uint64)
    back = (value >> shift) | np.where(shift > 0, value << (np.uint64(64) - np.maximum(shift, np.uint64(1))), np.uint64(0))
    away = np.flatnonzero(root != np.arange(len(value)))
    return pd.DataFrame({"u": back[away].view(np.int64), "v": back[root[away]].view(np.int64)})


PAIR = ["block", "depth", "p", "q"]


def node_pairs(dealt: DataFrame, split_over: int, step: int) -> DataFrame:
    """Rows (block, depth, p, q, rotated): the pairs of trie nodes (prefixes p <= q of ``depth`` bits) to walk and the
    fingerprints under them, none with more than ``split_over`` of these.  ``dealt``: (block, rotated).

    A larger pair is replaced by the pairs of its nodes' descendants ``step`` bits below that are within the budget; this
    is repeated until no pair is too large."""
    prefix = lambda depth: F.shiftrightunsigned("rotated", BITS - depth)
    rows = dealt.select("block", F.lit(BLOCK).cast("long").alias("depth"), prefix(BLOCK).alias("p"), prefix(BLOCK).alias("q"), "rotated")
    ready: list[DataFrame] = []
    for depth in range(BLOCK, BITS + 1, step):
        of_q = F.count_if((F.col("p") != F.col("q")) & (prefix(depth) == F.col("q")))
        counts = rows.groupBy(*PAIR).agg(F.count("*").alias("n"), of_q.alias("n_q"))
        # a pair wants a fingerprint on each side
        counts = counts.filter((F.col("n") > 1) & ((F.col("p") == F.col("q")) | (F.col("n_q") > 0) & (F.col("n_q") < F.col("n"))))
        counts = materialize(counts.select(*PAIR, ((F.col("n") > split_over) & F.lit(depth + step <= BITS)).alias("large")), "node-pairs")
        marked = rows.join(counts, PAIR)
        ready.append(marked.filter("not large").select(*PAIR, "rotated"))
        if counts.filter("large").isEmpty():
            break
        # the descendants: this row's own below p or q, with each of the other's (or its own node's) within the budget
        near = [[q for q in range(1 << step) if (p ^ q).bit_count() <= BUDGET] for p in range(1 << step)]
        tail = prefix(depth + step).bitwiseAND((1 << step) - 1)
        partners = F.element_at(F.array(*[F.array(*[F.lit(q).cast("long") for q in row]) for row in near]), (tail + 1).cast("int"))
        apart = F.when(prefix(depth) == F.col("p"), F.col("q")).otherwise(F.col("p"))
        below = marked.filter("large").select("block", "rotated", prefix(depth + step).alias("mine"), F.shiftleft(apart, step).alias("apart"), F.explode(partners).alias("partner"))
        below = below.select("block", "rotated", "mine", (F.col("apart") + F.col("partner")).alias("other"))
        low, high = F.when(F.expr("mine < other"), F.col("mine")).otherwise(F.col("other")), F.when(F.expr("mine < other"), F.col("other")).otherwise(F.col("mine"))
        below = below.filter(F.bit_count(F.col("mine").bitwiseXOR(F.col("other"))) <= BUDGET)
        rows = materialize(below.select("block", F.lit(depth + step).cast("long").alias("depth"), low.alias("p"), high.alias("q"), "rotated"), "below")
    return reduce(DataFrame.unionByName, ready)


def link_edges(distinct: DataFrame, col: str = "fingerprint", split_over: int = 50_000, step: int = 6) -> DataFrame:
    """Edges (u, v) that span all links between the distinct fingerprints in ``col``."""
    rotate = F.array(*[
        F.struct(
            F.lit(b).cast("long").alias("block"),
            F.expr(f"shiftleft(`{col}`, {b * BLOCK}) | shiftrightunsigned(`{col}`, {64 - b * BLOCK})" if b else f"`{col}`").alias("rotated"),
        )
        for b in range(BITS // BLOCK)
    ])
    dealt = materialize(distinct.select(F.explode(rotate).alias("r")).select("r.*"), "rotated")

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        size = 0
        for pdf in batches:
            # pairs arrive one after the other: cut where the last one starts
            other = (pdf[PAIR] != pdf[PAIR].iloc[-1]).any(axis=1).to_numpy() if len(pdf) else np.zeros(0, bool)
            cut = int(np.flatnonzero(other)[-1]) + 1 if other.any() else 0
            if cut and size + cut >= 200_000:
                yield _links_of_groups(pd.concat([*held, pdf.iloc[:cut]], ignore_index=True))
                held, size, pdf = [], 0, pdf.iloc[cut:]
            held.append(pdf)
            size += len(pdf)
        if held:
            yield _links_of_groups(pd.concat(held, ignore_index=True))

    pairs = node_pairs(dealt, split_over, step)
    return pairs.repartition(*PAIR).sortWithinPartitions(*PAIR).mapInPandas(walk, "u long, v long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v): root is the least node of its component.

    Alternates large-star and small-star steps; each step is one grouped minimum (combined before the shuffle) and one
    join, so a hub with very many neighbours is never gathered anywhere.  Each round is a written table.
    """
    def least_neighbour(e: DataFrame) -> DataFrame:
        return e.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    current = materialize(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    before = state(current)
    while before[0]:
        # minima are stored before they are joined: then a hub's side can be split
        both = current.select("u", "v").union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(materialize(least_neighbour(both), "least"), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        large = materialize(large.distinct(), "large-star")
        least = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").select(F.col("v").alias("x"), "m", "u")
        small = small.select("x", "m").union(small.select(F.col("u").alias("x"), "m")).filter("x <> m")
        current = materialize(small.select(F.col("x").alias("u"), F.col("m").alias("v")).distinct(), "links")
        now = state(current)
        if now == before:
            break
        before = now
    return current.select(F.col("u").alias("node"), F.col("v").alias("root")).union(current.select(F.col("v"), F.col("v"))).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """One row per document: ``_row``, the id, ``fingerprint`` (long) and ``component_id`` (least id reachable)."""
    return _classes(numbered(fingerprints(docs.select(id_col, text_col), text_col, shingle).select(id_col, "fingerprint"), "fingerprints"), id_col)


def _classes(marked: DataFrame, id_col: str) -> DataFrame:
    spark = marked.sparkSession
    distinct = materialize(marked.groupBy("fingerprint").agg(F.min(id_col).alias("least")), "distinct-fingerprints")
    edges = settled(spark, "edges", lambda: link_edges(distinct))
    roots = settled(spark, "roots", lambda: components(edges))
    rooted = materialize(distinct.join(roots, distinct.fingerprint == roots.node, "left").select("fingerprint", "least", F.coalesce("root", "fingerprint").alias("root")), "rooted")
    named = materialize(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "named")
    classes = rooted.join(named, "root").select("fingerprint", "component_id")
    return marked.join(classes, "fingerprint").select("_row", id_col, "fingerprint", "component_id")


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``docs`` without near-duplicates: the row with the least id (then the first stored) of each component stays."""
    keyed = numbered(boxed(docs), "documents")
    marked = fingerprints(keyed.select("_row", F.col(f"_doc.`{id_col}`").alias("id"), F.col(f"_doc.`{text_col}`").alias("text")), "text", shingle)
    found = settled(docs.sparkSession, "classes", lambda: _classes(materialize(marked.select("_row", "id", "fingerprint"), "fingerprints"), "id"))
    first = found.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", F.col("_row").alias("r")))["r"].alias("_row"))
    dropped = found.select("_row").join(first.select("_row"), "_row", "left_anti")
    return keyed.join(dropped, "_row", "left_anti").select("_doc.*")
