"""SimHash components and substring dedup against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from alarmlens.llm import simhash, substring_dedup

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _row string, fingerprint string"


def corpus(seed=1, n=120):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)] + ["É", "naïve", "ß,"]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    texts = []
    for k in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 200))]
        if k % 5 == 0:
            words[3:3] = passage[: rng.randint(34, 60)]
        if k % 7 == 0 and texts:
            words = (rng.choice(texts) or "").split()
            if words and k % 2:
                words[rng.randrange(len(words))] = "edited"
        if k % 11 == 0:
            words = ["same"] * rng.randint(0, 80)
        texts.append(" ".join(words))
    texts += [None, None, "", "  \n ", "one two", "ONE two", "a b c d", "\t".join(passage)]
    return [(k, t) for k, t in enumerate(texts)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 0, "x", "y") for i, t in rows], SCHEMA)


def stored(df, tmp_path, name="docs"):
    df.write.mode("overwrite").parquet(str(tmp_path / name))
    return df.sparkSession.read.parquet(str(tmp_path / name))


def removed(texts, window=35):
    split = [WORDS.findall(t or "") for t in texts]
    seen = {}
    for k, words in enumerate(split):
        for i in range(len(words) - window + 1):
            seen.setdefault(tuple(words[i : i + window]), []).append((k, i))
    out = [[False] * len(w) for w in split]
    for places in seen.values():
        if len(places) > 1:
            for k, i in places:
                out[k][i : i + window] = [True] * window
    return split, out


def slow_fingerprint(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = WORDS.findall(low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("window", [35, 6, 3])
def test_substring_dedup_is_exact(spark, tmp_path, window):
    rows = corpus()
    rows.append(rows[5])  # a repeated row is a document of its own
    found = substring_dedup.dedup_digest(stored(frame(spark, rows), tmp_path), window=window).collect()
    split, gone = removed([t for _, t in rows], window)
    want = sorted((i, len(w), sum(g), hashlib.sha256(" ".join(x for x, r in zip(w, g) if not r).encode()).hexdigest()) for (i, _), w, g in zip(rows, split, gone))
    assert sorted(tuple(r) for r in found) == want


def test_texts_without_repeats(spark, tmp_path):
    rows = corpus(3)
    docs = stored(frame(spark, rows), tmp_path)
    out = substring_dedup.without_repeats(docs)
    assert out.columns == docs.columns
    split, gone = removed([t for _, t in rows])
    want = {i: t if not any(g) else " ".join(x for x, r in zip(w, g) if not r) for (i, t), w, g in zip(rows, split, gone)}
    got = {r.doc_id: (r.text, r["_row"]) for r in out.collect()}
    assert got == {i: (t, "x") for i, t in want.items()}


def test_very_long_text(spark, tmp_path):
    long = " ".join(f"t{k}" for k in range(60_000))
    docs = stored(frame(spark, [(1, long), (2, long + " end"), (None, "short")]), tmp_path)
    got = {r.doc_id: r.n_removed for r in substring_dedup.dedup_digest(docs).collect()}
    assert got == {1: 60_000, 2: 60_000, None: 0}


def test_simhash_components(spark, tmp_path):
    rows = corpus(2, 200)
    base = " ".join(f"v{k}" for k in range(400))
    rows += [(1000 + k, base.replace(f"v{k * 7} ", f"u{k} ")) for k in range(20)] + [(5, rows[5][1])]
    got = simhash.near_duplicates(stored(frame(spark, rows), tmp_path)).collect()
    prints = [slow_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(i, least.get(find(k), i))
    want = sorted((i, prints[k], least[find(k)]) for k, (i, _) in enumerate(rows))
    assert sorted((r.doc_id, r.fingerprint % 2**64, r.component_id) for r in got) == want


def test_trie_walk_finds_all_links():
    rng = np.random.default_rng(0)
    seeds = rng.integers(0, 2**63, 40, dtype=np.uint64)
    x = np.unique(np.concatenate([s ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (60, 2)).astype(np.uint64), axis=1) for s in seeds]))
    one = lambda v: np.array([v])
    root, walked = simhash.trie_links(x, [one(0), one(len(x)), one(0), one(len(x)), one(0)], one(0), wide=50)
    assert 2 * len(x) < walked < len(x) ** 2 / 4  # the walk prunes
    near = np.bitwise_count(x[:, None] ^ x[None, :]) <= 3
    want = np.arange(len(x))
    while True:
        new = np.where(near, want[None, :], len(x)).min(axis=1)
        if (new == want).all():
            break
        want = new
    assert (root == want).all()


def test_crowded_blocks_are_split_without_loss(spark):
    rng = random.Random(4)
    base = 0x1234 << 48
    values = sorted({base | rng.getrandbits(10) | (rng.getrandbits(6) << 42) for _ in range(600)})
    df = spark.createDataFrame([(v,) for v in values], "fingerprint long")

    def classes(split_over, step=6):
        rows = simhash.components(simhash.link_edges(df, split_over=split_over, step=step)).collect()
        return {r.node: r.root for r in rows}

    whole = classes(10**6)
    assert classes(10) == whole
    assert classes(3, 4) == whole


def test_no_pair_of_nodes_is_crowded(spark):
    rng = random.Random(8)
    base = rng.getrandbits(64)
    values = {base ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(900)}
    df = spark.createDataFrame([(0, v - 2**64 if v >> 63 else v) for v in values], "block long, rotated long")
    sizes = simhash.node_pairs(df, 40, 6).groupBy(*simhash.PAIR).count().toPandas()
    assert len(sizes) > 20 and sizes["depth"].max() > 22 and sizes["count"].max() <= 40


def test_all_links_of_the_tables_come_from_walks(spark):
    """On the given table every subtree with two fingerprints or more is walked, node by node, and each link is found."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    x = np.unique(simhash.fingerprints(docs, "text").select("fingerprint").toPandas()["fingerprint"].to_numpy().view(np.uint64))
    one = lambda v: np.array([v])
    root, walked = simhash.trie_links(x, [one(0), one(len(x)), one(0), one(len(x)), one(0)], one(0))
    assert walked > len(x)
    linked = {tuple(sorted((int(a), int(b)))) for a, b in zip(x[root != np.arange(len(x))], x[root[root != np.arange(len(x))]])}
    edges = simhash.link_edges(spark.createDataFrame([(v,) for v in x.view(np.int64).tolist()], "fingerprint long")).collect()
    found = simhash.components(spark.createDataFrame([(r.u, r.v) for r in edges], "u long, v long")).collect()
    least = {}
    for r in found:
        least.setdefault(r.root, set()).add(r.node % 2**64)
    assert {min(g) for g in least.values()} == {a for a, _ in linked} and sum(len(g) - 1 for g in least.values()) == len(linked)


def test_results_do_not_depend_on_how_a_scan_is_split(spark, tmp_path):
    """A table of many row groups is split by the parallelism of the moment; it changes between two steps here."""
    rows = corpus(6, 400)
    frame(spark, rows).repartition(1).write.option("parquet.block.size", 1024).parquet(str(tmp_path / "many"))
    docs = spark.read.parquet(str(tmp_path / "many"))
    real, calls = substring_dedup.materialize, []

    def moving(df, name):
        calls.append(name)
        spark.conf.set("spark.sql.leafNodeDefaultParallelism", str(1 + 15 * (len(calls) % 2)))
        return real(df, name)

    want = sorted(tuple(r) for r in substring_dedup.dedup_digest(docs).collect())
    kept = sorted(r.doc_id for r in simhash.keep_one_of_each(docs).collect())
    try:
        for module in (substring_dedup, simhash):
            module.materialize = moving
        assert sorted(tuple(r) for r in substring_dedup.dedup_digest(docs).collect()) == want
        assert sorted(r.doc_id for r in simhash.keep_one_of_each(docs).collect()) == kept
        assert len(calls) > 6
    finally:
        spark.conf.unset("spark.sql.leafNodeDefaultParallelism")
        for module in (substring_dedup, simhash):
            module.materialize = real


def test_keep_one(spark, tmp_path):
    rows = [(3, "a b c d e"), (1, "a b c d e"), (None, "a b c d e"), (7, "other words entirely here now"), (7, "other words entirely here now"), (9, None), (8, "")]
    docs = stored(frame(spark, rows), tmp_path)
    out = simhash.keep_one_of_each(docs)
    assert out.columns == docs.columns
    assert sorted(r.doc_id for r in out.collect()) == [1, 7, 8]


def test_empty_tables(spark, tmp_path):
    docs = stored(frame(spark, []), tmp_path)
    assert simhash.near_duplicates(docs).count() == 0
    assert simhash.keep_one_of_each(docs).count() == 0
    assert substring_dedup.dedup_digest(docs).count() == 0
    assert substring_dedup.without_repeats(docs).count() == 0
