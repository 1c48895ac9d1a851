"""Held-out accuracy of the classifiers, counts and neighbours against brute force."""

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from alarmlens.llm import ann, quality, token_counts, toxicity

SF = "/root/testdata/sf0.1"


def auc(score, label):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(len(score))
    n1, n0 = (label == 1).sum(), (label == 0).sum()
    return (rank[label == 1].sum() - n1 * (n1 - 1) / 2) / (n1 * n0)


def joined(spark, scored, label):
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", label).filter(f"{label} IS NOT NULL")
    rows = scored.join(labels, "doc_id").filter("held_out").select("score", label).toPandas()
    return rows["score"].to_numpy(), rows[label].to_numpy()


@pytest.fixture(scope="module")
def toxicity_model(spark):
    """The registered query's model."""
    return toxicity.fit(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))


def test_toxicity_held_out(spark, toxicity_model):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = toxicity.scored(docs.select("doc_id", "text"), toxicity_model).withColumn("held_out", toxicity.held_out(F.col("doc_id"), 3, 1))
    score, label = joined(spark, rows, "toxic")
    assert auc(score, label) > 0.9
    assert ((score >= 0.7) & (label == 1)).sum() >= 0.85 * (label == 1).sum()
    assert ((score >= 0.7) & (label == 0)).sum() <= 0.03 * (label == 0).sum()


INSULTS = "idiot moron loser clown worthless stupid pathetic trash scum disgusting".split()
DISTURBED = {
    "plain": (1.0, lambda w, i, r: w), "capitals": (1.0, lambda w, i, r: w.upper()), "letters apart": (0.9, lambda w, i, r: " ".join(w)),
    "doubled": (0.9, lambda w, i, r: w[:i] + w[i - 1] + w[i:]), "one inserted": (0.9, lambda w, i, r: w[:i] + r() + w[i:]),
    "two inserted": (0.6, lambda w, i, r: w[:i] + r() + r() + w[i:]), "star inserted": (0.9, lambda w, i, r: f"{w[:i]}*{w[i:]}"),
    "star instead": (0.9, lambda w, i, r: f"{w[:i]}*{w[i + 1 :]}"), "dots": (0.9, lambda w, i, r: ".".join(w)), "hyphen": (0.9, lambda w, i, r: f"{w[:i]}-{w[i:]}"),
    "split": (0.9, lambda w, i, r: f"{w[:i]} {w[i:]}"), "one left out": (0.9, lambda w, i, r: w[:i] + w[i + 1 :]),
}


@pytest.mark.parametrize("kind", DISTURBED)
def test_disturbed_insults(spark, toxicity_model, kind):
    """Insults that the registered query's model learnt from the labels, in clean sentences, as its ``predicted`` sees them."""
    rng = random.Random(5)
    clean = spark.read.parquet(f"{SF}/labels.parquet").filter("toxic = 0").join(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id")
    clean = [r.text for r in clean.filter("length(text) between 60 and 900").orderBy("doc_id").limit(40).collect()]
    score = lambda texts: toxicity_model.score(toxicity_model.text_values(texts))
    clean = [t for t, s in zip(clean, score(clean)) if s < 0.3][:20]
    least, change = DISTURBED[kind]
    texts = []
    for word in INSULTS:
        for t in clean:
            words = t.split(" ")
            k = rng.randrange(len(words))
            words[k:k] = [change(word, rng.randrange(1, len(word)), lambda: rng.choice("abcdefghijklmnopqrstuvwxyz"))]
            texts.append(" ".join(words))
    assert (score(texts) >= 0.7).mean() >= least


def test_values_along_the_text_are_kernel_values():
    """A unit's value as a difference of sums is that of its own subsequences."""
    rng = np.random.default_rng(1)
    weights = rng.normal(size=toxicity.CODES**3).astype(np.float32)
    texts = ["Zo.rg bl a t! é ÀB cd\nend", "", None, "x" * 60 + " abc", "the i d i o t said. No", "a bb ccc dddd eeeee ffffff"]
    s = toxicity.Sentences(texts)
    units = [s.unit(k) for k in range(len(s.doc))]
    assert s.values(weights) == pytest.approx(toxicity._linear(units, weights), abs=1e-3)
    assert {u[1:-1] for u in units} >= {bytes(map(" abcdefghijklmnopqrstuvwxyz".index, w)) for w in ("zorg", "zorgblat", "idiot", "theidiot", "ccc")}
    assert not any(u[1:-1] == bytes(map(" abcdefghijklmnopqrstuvwxyz".index, "saidno")) for u in units)  # of two sentences


def test_quality_held_out(spark):
    from alarmlens.llm.queries import op8_quality_trees

    score, label = joined(spark, op8_quality_trees(spark, SF), "quality")
    assert auc(score, label) > 0.9


def test_texts_without_words(spark):
    model = toxicity.train(["bad zorg", "fine day"] * 20, np.array([1, 0] * 20))
    df = spark.createDataFrame([(1, None), (2, ""), (3, "\n \t"), (None, "zorg"), (5, "!!!")], "doc_id long, text string")
    got = {r.doc_id: r.score for r in toxicity.scored(df, model).collect()}
    assert got[1] == got[2] == got[3] == got[5] and 0 <= got[None] <= 1
    assert got[None] > got[1]
    clash = df.withColumn("score", F.lit("mine")).withColumn("_score", F.lit(1))
    assert {r.doc_id: r.score for r in toxicity.scored(clash, model).collect()} == got
    nothing = toxicity.train([], np.array([]))
    assert {r.score for r in toxicity.scored(df, nothing).collect()} == {0.5}
    assert toxicity.scored(df.limit(0), model).count() == 0


def test_held_out_rows(spark):
    ids = [(k,) for k in range(200)] + [(None,), (-5,)]
    df = spark.createDataFrame(ids, "doc_id long")
    got = {r.doc_id: r.h for r in df.select("doc_id", toxicity.held_out(df.doc_id, 3, 1).alias("h")).collect()}
    assert got == {i: i is not None and zlib.crc32(str(i).encode()) % 3 == 1 for (i,) in ids}


def test_trees_separate_what_can_be_separated():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1500, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 3] < -0.2)).astype(int)
    trees = quality.train(x[:1000], y[:1000], trees=60)
    assert auc(trees.predict(x[1000:]), y[1000:]) > 0.97

    def slow(row):
        total = trees.base
        for f, lim, v in zip(trees.feature, trees.limit, trees.value):
            node = 0
            while node < len(f):
                node = 2 * node + (2 if row[f[node]] > lim[node] else 1)
            total += v[node - len(f)]
        return 1 / (1 + math.exp(-total))

    assert trees.predict(x[1000:1050]) == pytest.approx([slow(r) for r in x[1000:1050]])


def test_statistics_of_odd_texts(spark):
    for t in (None, "", " \n", "a", "é" * 100, "|" * 5000, "\ud800".encode("utf-8", "surrogatepass").decode("utf-8", "replace"), "A!! " * 10_000):
        row = quality.statistics(t)
        assert len(row) == len(quality.STATISTICS) and all(math.isfinite(v) for v in row)
    nothing = quality.train(np.zeros((0, len(quality.STATISTICS))), np.array([]))
    df = spark.createDataFrame([(1, None), (2, "x")], "doc_id long, text string")
    assert {r.score for r in quality.scored(df, nothing).collect()} == {0.5}


def slow_count(word, pieces):
    """Fewest pieces of the best-scored way to spell a word."""
    text = token_counts.MARK + word
    floor = min(pieces.values())
    best = [(0.0, 0)]
    for end in range(1, len(text) + 1):
        ways = [(best[a][0] + pieces[text[a:end]], best[a][1] + 1) for a in range(end) if text[a:end] in pieces]
        if not ways:
            n = len(text[end - 1].encode())
            ways = [(best[end - 1][0] + n * floor, best[end - 1][1] + n)]
        best.append(max(ways, key=lambda w: (w[0], -w[1])))
    return best[-1][1]


def test_token_counts(spark):
    pieces = token_counts.zipf_pieces(token_counts.default_vocabulary())
    rng = random.Random(3)
    parts = ["the", "ing", "un", "é", "中", "x", "tion", "qu", "🙂", "1", ".", "A"]
    words = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 6))) for _ in range(400)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 60))) for _ in range(40)] + [None, "", " \n ", "same same", "same same", "y" * 3000]
    df = spark.createDataFrame([(k, t, 7) for k, t in enumerate(texts)], "doc_id long, text string, n_words int")
    out = token_counts.count_tokens(df)
    assert out.columns == ["doc_id", "text", "n_words", "n_tokens"]
    for r in out.collect():
        split = (texts[r.doc_id] or "").split()
        assert (r.n_words, r.n_tokens) == (len(split), sum(slow_count(w, pieces) for w in split))


def test_trie_shares_prefixes():
    trie = token_counts.UnigramTrie({"a": -1.0, "ab": -1.5, "b": -2.0, token_counts.MARK: -0.5}, most=12)
    of = lambda *words: [trie.counts[trie.terminal[w]] for w in words]
    trie.insert(["ab", "aba", "abab", "b"])
    assert trie.scored == 1 + 4 + 1  # the mark, a-b-a-b once, b
    assert of("ab", "aba", "abab", "b") == [2, 3, 3, 2]
    trie.insert(["abb", "aba"])  # a later batch: one node is new
    assert trie.scored == 7 and of("abb", "abab") == [3, 3]
    # begun anew beyond its bound, with the same counts
    want = [trie.count("ab" * k) for k in range(1, 8)]
    assert len(trie.score) > 12 and trie.count("aa b abb") == (3, 8) and len(trie.score) < 12
    assert [trie.count("ab" * k) for k in range(1, 8)] == want


def neighbours(rows, k=20):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(c is not None and math.isfinite(c) for c in v) and any(v)]
    out = {}
    for q, x in good:
        if q % 20 == 0:
            found = sorted((-float(x @ y), i) for i, y in good if i != q)
            out[q] = [(i, -s) for s, i in found[:k]]
    return out


def test_search_few_vectors(spark):
    rng = np.random.default_rng(4)
    rows = [(k, (rng.normal(size=8) * rng.choice([0.5, 1, 3])).tolist()) for k in range(60)]
    rows += [(100 + k, rows[3][1]) for k in range(30)]
    rows += [(200, None), (220, [0.0] * 8), (240, [1.0, None] + [0.0] * 6), (260, [float("nan")] * 8), (280, [float("inf")] * 8), (None, rows[0][1]), (300, [1.0])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<double>, label int")
    got = {}
    for r in ann.search(df).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id])
    want = neighbours([r for r in rows if r[0] != 300])
    assert set(got) == set(want)
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]]
        assert [s for _, s in got[q]] == pytest.approx([s for _, s in want[q]])
    assert ann.search(df.limit(0)).count() == 0


def test_repeated_query_rows(spark):
    """Rows that share an id are asked each by itself, whether their vectors are equal or not."""
    rng = np.random.default_rng(9)
    rows = [(k, rng.normal(size=8).tolist()) for k in range(60)]
    rows += [(20, rows[20][1])] * 2 + [(40, rng.normal(size=8).tolist()), (7, rows[7][1])]
    want = []
    for q, x in rows:
        if q % 20 == 0:
            found = sorted((-float(np.dot(x, y)), i) for i, y in rows if i != q)[:20]
            want += [(q, n, i, round(-s, 9)) for n, (s, i) in enumerate(found, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted((r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in ann.search(df).collect()) == sorted(want)


def test_search_recall(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(6000, 24))
    x /= np.linalg.norm(x, axis=1)[:, None]
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.search(df).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for q in range(0, 6000, 20):
        s = x @ x[q]
        s[q] = -9
        hits += len(got[q] & set(np.argsort(-s)[:20].tolist()))
    assert hits / (300 * 20) >= 0.9
    assert {len(v) for v in got.values()} == {20}  # a query whose neighbours lie elsewhere still gets its number


@pytest.mark.parametrize(("sf", "sample", "least"), [("sf0.001", ann.SAMPLE, 0.92), ("sf0.01", ann.SAMPLE, 0.92), ("sf0.1", ann.SAMPLE, 0.92), ("sf0.1", 500, 0.9)])
def test_recall_on_the_given_tables(spark, monkeypatch, sf, sample, least):
    """Fitted on the whole table, and on a sample that is a small part of it, as on large tables."""
    monkeypatch.setattr(ann, "SAMPLE", sample)
    df = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    rows = df.select("vec_id", "embedding").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], np.float64)
    got = {}
    for r in ann.search(df).collect():
        got.setdefault(r.query_id, []).append(r.score)
    asked = ids[ids % 20 == 0]
    assert set(got) == set(asked.tolist()) and {len(v) for v in got.values()} == {20}
    hits = 0
    for q in asked:
        score = np.sort((x @ x[ids == q][0])[ids != q])[::-1]
        hits += sum(s >= score[19] - 1e-12 for s in got[q])
    assert hits / (20 * len(asked)) >= least


@pytest.mark.parametrize("epsilon", [ann.EPSILON, -3.0])
def test_every_query_gets_its_number(spark, monkeypatch, epsilon):
    """Where the sample is the whole table too, and even if the test abandons nearly all."""
    monkeypatch.setattr(ann, "EPSILON", epsilon)
    rng = np.random.default_rng(10)
    x = rng.normal(size=(1500, 256))
    x /= np.linalg.norm(x, axis=1)[:, None]
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.search(df).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    assert {q: len(v) for q, v in got.items()} == dict.fromkeys(range(0, 1500, 20), 20)
    hits = 0
    for q, v in got.items():
        s = x @ x[q]
        s[q] = -9
        best = np.argsort(-s)[:20].tolist()
        hits += len(set(best) & {i for _, i in v})
        assert epsilon > 0 or [i for _, i in sorted(v)] == best  # asked again, in all lists
    assert hits / (75 * 20) > 0.6


def test_many_equal_vectors(spark):
    """The nearest of a vector in a large group of equal ones are those of the least ids."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(1500, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[::3] = x[0]
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.search(df).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    for q in range(0, 1500, 60):
        assert got[q] == [k for k in range(0, 1500, 3) if k != q][:20]


def test_scan_agrees_with_all_pairs():
    rng = np.random.default_rng(6)
    x, q = rng.normal(size=(3000, 65)), rng.normal(size=(40, 65))
    at, to = ann.scan(x, q, np.arange(3000), -1 - np.arange(40), 20)
    d = ((q[:, None, :] - x[None, :, :]) ** 2).sum(axis=2)
    kept = {(a, b) for a, b in zip(at.tolist(), to.tolist())}
    true = [(a, b) for a in range(40) for b in np.argsort(d[a])[:20]]
    assert sum(p in kept for p in true) / len(true) > 0.97
    assert len(kept) < 0.5 * d.size


def test_a_repeated_id_counts_once(spark):
    docs = spark.createDataFrame([(1, "b"), (1, "a"), (1, None), (2, "c"), (3, "d")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(8)] + [(1, 1), (None, 0), (2, None)], "doc_id long, toxic int")
    got = toxicity.labelled_sample(docs, labels, "toxic", "doc_id", "text", 3, 1, 100).collect()
    kept = [k for k in (1, 2, 3) if zlib.crc32(str(k).encode()) % 3 != 1]
    assert sorted(tuple(r) for r in got) == [(k, {1: "a", 2: "c", 3: "d"}[k], k % 2) for k in kept]
