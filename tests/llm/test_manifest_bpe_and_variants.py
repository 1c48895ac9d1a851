"""Merkle manifests, byte-level BPE and spelling variants against plain statements of what they do."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from alarmlens.llm import byte_bpe, merkle, variants

CLASHING = ["tree", "rank", "node", "of", "_part", "_scan", "leaf", "found", "path", "ids", "n_tokens", "word", "n", "code", "root", "id"]


def stored(df, path):
    df.write.parquet(str(path))
    return df.sparkSession.read.parquet(str(path))


# ------------------------------------------------------------------ Merkle manifest


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree_of(digests):
    """Root of digests in order, and each one's siblings from below (left, right)."""
    paths, at = [[] for _ in digests], {k: [k] for k in range(len(digests))}
    while len(digests) > 1:
        above, under = [], {}
        for k in range(0, len(digests), 16):
            run = digests[k : k + 16]
            for j in range(len(run)):
                for leaf in at[k + j]:
                    paths[leaf].append(("".join(run[:j]), "".join(run[j + 1 :])))
            under[len(above)] = [leaf for j in range(len(run)) for leaf in at[k + j]]
            above.append(sha(*run))
        digests, at = above, under
    return digests[0], paths


def manifest_of(rows):
    """Plainly: the rows that ``verified`` gives."""
    field = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    leaf_of = lambda r, text: sha(*[field(x) for x in (r[0], r[1], r[2], r[3], text)])
    by_source = {}
    for r in rows:
        by_source.setdefault(r[1], []).append((r, leaf_of(r, r[4])))
    sources = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in sources:
        own = sorted(by_source[s], key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
        trees[s] = (own, *tree_of([leaf for _, leaf in own]))
    root, above = tree_of([trees[s][1] for s in sources])
    out = []
    for k, s in enumerate(sources):
        own, subroot, paths = trees[s]
        for (r, leaf), path in zip(own, paths, strict=True):
            node = leaf
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None:
                node = leaf_of(r, "".join(c.lower() if c.isascii() else c for c in r[4]))
            for a, b in path + above[k]:
                node = sha(a, node, b)
            out.append((r[0], leaf, subroot, root, sha(*[x for pair in path + above[k] for x in pair]), node, node == root))
    return out


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def made(sources, seed=1):
    rng = random.Random(seed)
    rows, k = [], 0
    for s, n in sources:
        for _ in range(n):
            k += 1
            text = rng.choice([None, "", "É Some Text", f"a text of {k}", "LOUD"])
            rows.append((rng.randrange(10**6), s, rng.choice(["en", None]), rng.choice([k, None]), text))
    return rows


@pytest.mark.parametrize("sources", [[("a", 1)], [("a", 2)], [(None, 1), ("a", 1), ("", 17)], [("hot", 300), (None, 33), ("é", 16), ("z", 257), ("Z", 1)], [(f"s{k}", 1 + k % 3) for k in range(40)]])
def test_manifest(spark, tmp_path, sources):
    rows = made(sources)
    rows += [(None, *rows[0][1:]), (None, *rows[0][1:]), rows[0], rows[0]]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("mine") for c in CLASHING}).repartition(5)
    got = merkle.verified(stored(df, tmp_path / "docs"), merkle.disturbed())
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(manifest_of(rows), key=key)


def test_repeated_rows_of_a_hot_source_are_dealt_apart(spark, tmp_path):
    """One row, half of the table, is in many parts of the sort."""
    rows = [(7, "a", "en", 1, "same")] * 4000 + [(k, "a", "en", 1, str(k)) for k in range(4000)]
    docs, key = stored(spark.createDataFrame(rows, SCHEMA).repartition(8), tmp_path / "docs"), "spark.sql.adaptive.coalescePartitions.enabled"
    was = spark.conf.get(key)
    spark.conf.set(key, "false")  # or so few rows would be put together again
    try:
        df = merkle.ranked(merkle.leaves(docs), ["tree"], ["id", "leaf", "found"], "test")
    finally:
        spark.conf.set(key, was)
    assert sorted(r["rank"] for r in df.select("rank").collect()) == list(range(8000)) and df.select("of").distinct().collect()[0][0] == 8000
    same = spark.read.parquet(*df.inputFiles()).filter("id = 7").groupBy(F.input_file_name()).count().collect()
    assert len(same) > 2


def test_manifest_of_nothing(spark):
    assert merkle.verified(spark.createDataFrame([], SCHEMA), merkle.disturbed()).count() == 0


# ------------------------------------------------------------------ byte-level BPE


@pytest.fixture(scope="module")
def both():
    import public_tokenizers
    import tiktoken

    path = byte_bpe.default_ranks()
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(path), special_tokens={})
    return byte_bpe.tokenizer(path, public_tokenizers.PATTERN), library


def ids_of(tok, text):
    return np.frombuffer(b"".join(tok.blocks(text)), "<u4").tolist()


def test_ids_are_the_library_s(both):
    tok, library = both
    rng = random.Random(5)
    kinds = [
        lambda: chr(rng.randrange(0x110000)), lambda: chr(rng.randrange(32, 127)), lambda: rng.choice("etaoin shr"), lambda: rng.choice(" \n\t\r\x0b\x1c\x85\xa0 ab1."),
        lambda: rng.choice("'sStTrevlmd ’é中日\U0001f600"), lambda: chr(rng.randrange(0x300, 0x3000)), lambda: rng.choice("aeiou=-*"),
    ]
    for k in range(7000):
        kind = kinds[k % len(kinds)]
        text = "".join(kind() for _ in range(rng.randrange(1, 40)))
        text = "".join(c for c in text if not 0xD800 <= ord(c) < 0xE000)
        assert ids_of(tok, text) == library.encode_ordinary(text), repr(text)
    for text in ("", " ", "a" * 999, " " * 999, "ab" * 3000, "<|endoftext|>", "՘࢏\U00011de0" * 3, "x" * 50 + "\n" * 50):
        assert ids_of(tok, text) == library.encode_ordinary(text)
        assert tok.decode(b"".join(tok.blocks(text))) == text.encode()


def test_disputed_characters_are_asked_of_the_library():
    assert all(regex.match(r"\p{L}", chr(c)) for c in byte_bpe.disputed(r"\p{L}"))


def test_merges_of_a_small_vocabulary():
    """Against merging pair by pair, for vocabularies whose tokens overlap in every way."""
    import tiktoken

    rng = random.Random(2)
    text = lambda most: bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, most)))
    for _ in range(12):
        ranks = {bytes([c]): k for k, c in enumerate(b"abc")}
        rest = {bytes([c]): 1000 + c for c in range(256) if bytes([c]) not in ranks}
        while len(ranks) < 30:  # a neighbouring pair of a text as it is merged so far
            library = tiktoken.Encoding("small", pat_str=r"[\s\S]+", mergeable_ranks=ranks | rest, special_tokens={})
            ids = library.encode_ordinary(text(40).decode())
            if len(ids) > 1:
                k = rng.randrange(len(ids) - 1)
                ranks.setdefault(library.decode_bytes(ids[k : k + 2]), len(ranks))
        library = tiktoken.Encoding("small", pat_str=r"[\s\S]+", mergeable_ranks=ranks | rest, special_tokens={})
        merges = byte_bpe.Merges(ranks)
        for _ in range(200):
            piece = text(40)
            assert merges.encode(piece) == library.encode_ordinary(piece.decode()), (ranks, piece)


def test_digests_there_and_back(spark, tmp_path, both):
    _, library = both
    long = " ".join(f"word{k} Ünïcode\n" for k in range(150_000))  # a text of 3 MB, cut in blocks
    texts = [None, "", "two words", "two words", long, "\U00011de0 ՘"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").withColumns({c: F.lit("mine") for c in CLASHING})
    df = stored(df, tmp_path / "docs")
    for r in byte_bpe.digested(df).collect():
        text = texts[r.doc_id] or ""
        ids = library.encode_ordinary(text)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest() and r.word == "mine"
    back = byte_bpe.decoded(byte_bpe.encoded(df)).collect()
    assert all(bytes(r.decoded).decode() == (texts[r.doc_id] or "") for r in back)
    assert byte_bpe.digested(df.limit(0)).count() == 0


# ------------------------------------------------------------------ spelling variants


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(long[:k] + long[k + 1 :] == short for k in range(len(long)))


def grouping_of(words):
    """Plainly: the rows that ``grouped`` gives for {word: n}."""
    facts = {}
    for w, n in words.items():
        close = [x for x in words if near(w, x)]
        best = min(close, key=lambda x: (-words[x], x), default=None)
        facts[w] = (n, len(close), best if best is not None and words[best] >= 2 * n else None)
    out = []
    for w, (n, count, form) in facts.items():
        root = w
        while facts[root][2] is not None:
            root = facts[root][2]
        out.append((w, form, root, n, count, words[form] if form else None))
    return sorted(out, key=str)


def vocabulary_of(rows):
    counts = Counter()
    for ident, text in rows:
        for run in regex.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if ident is None else ident}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def test_variants_of_texts(spark, tmp_path):
    rng = random.Random(3)
    base = ["".join(rng.choice("abcdeé") for _ in range(rng.randrange(5, 9))) for _ in range(60)]
    def word():
        w = rng.choice(base)
        k = rng.randrange(len(w))
        return w if rng.random() < 0.7 else w[:k] + rng.choice(["", "x", w[k] + "ÿ", "É", "A"]) + w[k + 1 :]
    rows = [(k, " ".join(word() + rng.choice(["", ",", "中", " ", "9"]) for _ in range(rng.randrange(60)))) for k in range(150)]
    rows += [(None, rows[0][1]), (None, None), (1, ""), rows[5], rows[5], (999, "Aa" * 70 + " " + "zebra " * 400_000 + "zebrA")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("mine") for c in CLASHING})
    got = variants.spelling_variants(stored(df, tmp_path / "docs"))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = grouping_of(vocabulary_of(rows))
    assert sorted(map(tuple, got.collect()), key=str) == want and any(r[1] for r in want)
    assert variants.spelling_variants(df.limit(0)).count() == 0


@pytest.mark.parametrize(("symbols", "most"), [(1, 3), (2, 20), (4, 1024), (90, 1)])
def test_large_classes_go_to_the_next_level(spark, symbols, most):
    """With one symbol all words of a length are one class; no link is lost on the way to more symbols."""
    rng = random.Random(4)
    words = {"".join(rng.choice("abÿ") for _ in range(rng.randrange(5, 8))): rng.randrange(3, 99) for _ in range(400)}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    got = [(r.a, r.n_a, r.b, r.n_b) for r in variants.near_pairs(df, symbols, most).collect()]
    assert all(words[a] == n and words[b] == m for a, n, b, m in got)
    found = Counter(frozenset((a, b)) for a, _, b, _ in got)
    assert found == Counter({frozenset((a, b)): 1 for a in words for b in words if a < b and near(a, b)})


def test_neighbourhoods_are_full_and_hold_each_once():
    rng = np.random.default_rng(0)
    for size in (1, 2, 5, 9):
        shapes = rng.integers(1, 4, (20, size)).astype(np.uint8)
        found = [set() for _ in shapes]
        for kind, row, code in variants.neighbours(shapes, 3, most=8):
            for r, c in zip(row.tolist(), code.tolist(), strict=True):
                assert (kind, c) not in found[r]
                found[r].add((kind, c))
        for shape, have in zip(shapes.tolist(), found, strict=True):
            number = lambda s: int(variants.codes(np.array([s], np.uint8))[0])
            want = {("same", number(shape))} | {("deleted", number(shape[:k] + shape[k + 1 :])) for k in range(size)}
            want |= {("replaced", number([*shape[:k], c, *shape[k + 1 :]])) for k in range(size) for c in (1, 2, 3) if c != shape[k]}
            want |= {("inserted", number([*shape[:k], c, *shape[k:]])) for k in range(size + 1) for c in (1, 2, 3)}
            assert have == want


def test_chains_of_forms(spark):
    """Each word's form is a word with twice its count, over many steps."""
    words = {"a" * (5 + k): 3 * 2**k for k in range(20)} | {"zzzzz": 5, "zzzzzz": 9}
    got = variants.grouped(spark.createDataFrame(list(words.items()), "word string, n long"))
    assert sorted(map(tuple, got.collect()), key=str) == grouping_of(words)


def test_tasks_without_words(spark):
    """Parts of the table that hold no word, and a table that holds none."""
    rows = [(1, "a b c"), (2, None), (3, "planet planet planet"), (4, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4, "doc_id")
    assert [(r.word, r.n) for r in variants.vocabulary(docs, every=10**12).collect()] == [("planet", 3)]
    assert variants.vocabulary(docs.filter("doc_id <> 3"), every=10**12).count() == 0
