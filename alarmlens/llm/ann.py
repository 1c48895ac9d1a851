"""Nearest neighbours by inner product: inverted lists scanned with adaptive dimensions.

Largest inner product becomes least distance by one more component, sqrt(M^2 - |x|^2), M the largest norm.  Vectors are
rotated at random, so that any few leading dimensions tell about the whole, and dealt to lists by nearest centroid.  A
query probes its nearest lists; how many is fitted, so that the probed lists hold ``recall`` of the true neighbours among
the sample's vectors.  Within a list the rotated vectors are scanned in blocks of columns: after each block a hypothesis
test compares the partial distance, scaled to all dimensions, with the query's current bound (at first from the sample's
vectors), and a candidate that fails is abandoned.  Survivors are scored exactly, in double precision, on the original
vectors.  The first bound lets at least about twice as many candidates in as are asked for.  A query that still ends with
too few is asked again in all lists, by a test that abandons nothing within the bound.

Rotation, centroids and the number of probes are fitted in a task on a bounded sample (``SAMPLE`` vectors, those of least
hash) and broadcast (10 MB at 64 dimensions); every vector is indexed.  Lists number half the square root of the vectors,
and no more than a quarter of the sample, by which they are told apart; beyond that they grow longer and are dealt in more
chunks.  A list's vectors and its queries are dealt in chunks of bounded size, so neither a list that holds a large part of
all vectors nor one that many queries probe is gathered in a task.  Vectors and queries are stored once each, in their own
precision; only the shuffle before the scan carries a query's vector to every list that it probes.

Defined results: vectors that are null, zero, of another length than most, or hold null or non-finite components take no
part, nor do rows without an id; rows with the query's own id are the query's own; rows that share an id are queries
(and candidates) each by itself, so n of them give n answers under that id; equal scores rank the smaller id first; with
fewer candidates than asked for, all are given; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import fitted_in_a_task, materialize, numbered

SAMPLE = 20_000
#: Vectors and queries that meet in one task, at most.
CHUNK, QUERY_CHUNK = 8192, 1024
COLUMNS = 16
#: Significance of the test: larger abandons fewer.
EPSILON = 2.1


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vector) of the vectors that take part."""
    v = F.col("vector")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"))
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = rows.filter(F.col("id").isNotNull() & v.isNotNull() & F.forall(v, fine) & F.exists(v, lambda x: x != 0))
    dims = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").limit(1)
    return rows.join(F.broadcast(dims.select("d")), F.size("vector") == F.col("d")).select("id", "vector")


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype(np.float64)


class Index:
    """Rotation and centroids."""

    def __init__(self, sample: np.ndarray, norm: float, lists: int, seed: int = 5, rounds: int = 12):
        rng = np.random.default_rng(seed)
        self.norm = norm
        d = sample.shape[1] + 1
        self.rotation = np.linalg.qr(rng.standard_normal((d, d)))[0]
        x = self.rotated(sample)
        picks = np.unique(x, axis=0)
        self.centroids = picks[rng.permutation(len(picks))[:lists]]
        for _ in range(rounds):
            near = self.lists_of(x)
            sums, n = np.zeros_like(self.centroids), np.bincount(near, minlength=len(self.centroids))
            np.add.at(sums, near, x)
            self.centroids = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], self.centroids)

    def refer(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        """Keep some vectors whose distances bound those of a query's neighbours from above."""
        self.reference_ids, self.reference = ids, self.rotated(vectors)
        self.reference_lists = self.lists_of(self.reference)

    def calibrate(self, vectors: np.ndarray, k: int, recall: float, queries: int = 256) -> int:
        """How many of its nearest lists a query must probe to meet ``recall`` of its ``k`` nearest reference vectors, on
        average over the first ``queries`` of these (in order of hash, so a random choice)."""
        q = self.rotated_query(vectors[:queries])
        near = self.distances(q).argsort(axis=1, kind="stable").argsort(axis=1)  # place of each list in a query's order
        likeness = vectors[:queries] @ vectors.T
        likeness[self.reference_ids[:queries, None] == self.reference_ids[None, :]] = -np.inf
        best = np.argsort(-likeness, axis=1)[:, :k]
        place = np.take_along_axis(near, self.reference_lists[best], axis=1)[np.isfinite(np.take_along_axis(likeness, best, axis=1))]
        return int(np.quantile(place, recall, method="higher")) + 1 if len(place) else len(self.centroids)

    def bounds_of(self, q: np.ndarray, q_id: np.ndarray, k: int, near: np.ndarray) -> np.ndarray:
        """The k-th least distance of each query among the reference vectors of the lists it probes, so that k lie
        within it; infinite if these are too few."""
        out = np.full(len(q), np.inf)
        if len(self.reference) < k:
            return out
        norms = (self.reference**2).sum(axis=1)
        for a in range(0, len(q), 128):
            part = q[a : a + 128]
            d = (part**2).sum(axis=1)[:, None] + norms[None, :] - 2 * part @ self.reference.T
            d[q_id[a : a + 128, None] == self.reference_ids[None, :]] = np.inf
            probed = np.zeros((len(part), len(self.centroids)), bool)
            np.put_along_axis(probed, near[a : a + 128], True, axis=1)
            d[~probed[:, self.reference_lists]] = np.inf
            out[a : a + 128] = np.partition(d, k - 1, axis=1)[:, k - 1]
        return out

    def rotated(self, x: np.ndarray) -> np.ndarray:
        more = np.sqrt(np.maximum(self.norm**2 - (x**2).sum(axis=1), 0))
        return np.hstack([x, more[:, None]]) @ self.rotation

    def rotated_query(self, q: np.ndarray) -> np.ndarray:
        """Queries are scaled to the largest norm, which changes no order, so that they lie where the vectors lie."""
        q = q * (self.norm / np.sqrt((q**2).sum(axis=1)))[:, None]
        return np.hstack([q, np.zeros((len(q), 1))]) @ self.rotation

    def distances(self, x: np.ndarray) -> np.ndarray:
        return (self.centroids**2).sum(axis=1) - 2 * x @ self.centroids.T

    def lists_of(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self.distances(x[a : a + 4096]).argmin(axis=1) for a in range(0, max(len(x), 1), 4096)])

    def probes_of(self, q: np.ndarray, count: int) -> np.ndarray:
        return np.argsort(self.distances(q), axis=1, kind="stable")[:, :count]


def scan(x: np.ndarray, q: np.ndarray, x_id: np.ndarray, q_id: np.ndarray, k: int, bound: np.ndarray | None = None, epsilon: float = EPSILON, step: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, candidate) of rotated vectors that no test abandons.

    Columns come in blocks; the bound of a query is its k-th least distance so far, or the one known before."""
    d = x.shape[1]
    known = np.full(len(q), np.inf) if bound is None else bound
    bound = known
    slack = 1e-9 * (1 + (q**2).sum(axis=1))  # rounding; vectors equal to the query have distances about zero
    best = np.full((len(q), k), np.inf)
    found_q, found_x = [], []
    for a in range(0, len(x), step):
        part = x[a : a + step]
        # all pairs are alive in the first block of columns: one product
        hi = min(d, COLUMNS)
        qa, xa = q[:, :hi], part[:, :hi]
        block = (qa**2).sum(axis=1)[:, None] + (xa**2).sum(axis=1)[None, :] - 2 * qa @ xa.T
        fine = (block * (d / hi) <= (bound * (1 + epsilon / np.sqrt(hi)) ** 2 + slack)[:, None]) & (q_id[:, None] != x_id[None, a : a + step])
        alive_q, alive_x = np.nonzero(fine)
        partial = block[fine]
        for lo in range(COLUMNS, d, COLUMNS):
            hi = min(d, lo + COLUMNS)
            partial = partial + ((q[alive_q, lo:hi] - part[alive_x, lo:hi]) ** 2).sum(axis=1)
            # the last block makes the distance whole
            most = (bound * (1 + epsilon / np.sqrt(hi)) ** 2 if hi < d else bound) + slack
            keep = partial * (d / hi) <= most[alive_q]
            alive_q, alive_x, partial = alive_q[keep], alive_x[keep], partial[keep]
        found_q.append(alive_q)
        found_x.append(alive_x + a)
        order = np.lexsort((partial, alive_q))
        rank = np.arange(len(order)) - np.searchsorted(alive_q[order], alive_q[order])
        first = rank < k
        fresh = np.full((len(q), k), np.inf)
        fresh[alive_q[order][first], rank[first]] = partial[order][first]
        best = np.sort(np.hstack([best, fresh]), axis=1)[:, :k]
        bound = np.minimum(known, best[:, -1])
    return np.concatenate(found_q), np.concatenate(found_x)


def search(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 20, k: int = 20, recall: float = 0.95) -> DataFrame:
    """The ``k`` nearest found of each query (rows whose id is divisible by ``every``): query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vector_col)
    square = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    count, largest = rows.agg(F.count("*"), F.max(square)).first()
    if not count:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")

    def train(picked: pd.DataFrame) -> tuple[Index, int]:
        picked = picked.sort_values(["hash", "id"], kind="stable")
        ids, sample = picked["id"].to_numpy(), _matrix(picked["vector"])
        index = Index(sample, float(np.sqrt(largest)), max(1, min(round(count**0.5 / 2), len(sample) // 4)))
        index.refer(ids, sample)
        return index, max(8, index.calibrate(sample, k, recall))

    picked = rows.withColumn("hash", F.xxhash64("id")).orderBy("hash", "id").limit(SAMPLE)
    index, probes = fitted_in_a_task(picked, train)
    shared = spark.sparkContext.broadcast(index)
    # among all vectors this rank is 2 k or more: what a test abandons can be replaced by the next nearest
    slack_rank = max(k, int(np.ceil(2 * k * len(index.reference) / count)))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = shared.value
        for pdf in batches:
            if len(pdf):
                yield pdf.assign(list=index.lists_of(index.rotated(_matrix(pdf["vector"]))))

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = shared.value
        for pdf in batches:
            if len(pdf):
                q = index.rotated_query(_matrix(pdf["vector"]))
                near = index.probes_of(q, probes).astype(np.int64)
                yield pdf.assign(bound=index.bounds_of(q, pdf["id"].to_numpy(), slack_rank, near), lists=list(near))

    vector_type = rows.schema["vector"].dataType.simpleString()
    placed = materialize(rows.mapInPandas(place, f"id long, vector {vector_type}, list long"), "lists")
    asked = rows.filter(F.col("id") % every == 0).mapInPandas(probe, f"id long, vector {vector_type}, bound double, lists array<long>")
    asked = numbered(asked, "probes", "query")

    def answers(asked: DataFrame, epsilon: float) -> DataFrame:
        """The best ``k`` of each query in the lists that ``asked`` names, a written table."""
        # how many chunks each list's vectors and queries are dealt into: one row for each list, bounded by their number
        asked = asked.select("query", "id", "vector", "bound", F.explode("lists").alias("list"))
        chunks = placed.groupBy("list").agg(F.ceil(F.count("*") / CHUNK).alias("parts"))
        chunks = chunks.join(asked.groupBy("list").agg(F.ceil(F.count("*") / QUERY_CHUNK).alias("query_parts")), "list")
        chunks = materialize(chunks, "chunks")
        again = chunks.select("list", F.col("parts").alias("all_parts"), F.col("query_parts").alias("all_query_parts"))
        each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
        left = placed.join(F.broadcast(chunks), "list").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts"))).withColumn("query_part", each("query_parts"))
        right = asked.join(F.broadcast(again), "list").withColumn("query_part", F.pmod(F.xxhash64("query"), F.col("all_query_parts"))).withColumn("part", each("all_parts"))
        keys = ["list", "part", "query_part"]
        left, right = left.select(*keys, "id", "vector"), right.select(*keys, "query", "id", "vector", "bound")

        def nearest(x: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
            index = shared.value
            if not len(x) or not len(q):
                return pd.DataFrame({"query": [], "query_id": [], "vec_id": [], "score": []})
            x = x.sort_values("id", kind="stable")
            xs, qs = _matrix(x["vector"]), _matrix(q["vector"])
            x_id, q_id = x["id"].to_numpy(), q["id"].to_numpy()
            at, to = scan(index.rotated(xs), index.rotated_query(qs), x_id, q_id, k, q["bound"].to_numpy(), epsilon)
            score = np.concatenate([(qs[at[a : a + 50_000]] * xs[to[a : a + 50_000]]).sum(axis=1) for a in range(0, max(len(at), 1), 50_000)])
            order = np.lexsort((x_id[to], -score, at))
            rank = np.arange(len(order)) - np.searchsorted(at[order], at[order])
            order = order[rank < k]
            return pd.DataFrame({"query": q["query"].to_numpy()[at[order]], "query_id": q_id[at[order]], "vec_id": x_id[to[order]], "score": score[order]})

        found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(nearest, "query long, query_id long, vec_id long, score double")
        order = W.partitionBy("query").orderBy(F.desc("score"), "vec_id")
        return materialize(found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k), "found")

    found = answers(asked, EPSILON)
    full = found.filter(F.col("rank") == k).select("query")
    short = materialize(asked.select("query").join(full, "query", "left_anti"), "short")
    if not short.isEmpty():
        every_list = F.sequence(F.lit(0).cast("long"), F.lit(len(index.centroids) - 1).cast("long"))
        again = asked.join(short, "query").withColumn("bound", F.lit(float("inf"))).withColumn("lists", every_list)
        # with this epsilon no partial distance rules out what the whole distance would not
        more = answers(materialize(again, "again"), float(np.sqrt(len(index.rotation))))
        found = found.join(short, "query", "left_anti").unionByName(more)
    return found.select("query_id", F.col("rank").cast("int"), "vec_id", "score")
