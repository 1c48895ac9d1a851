"""A text of several MB, and its copy, in every operator and every stage of the pipeline."""

import hashlib
import random

import numpy as np
import pytest

import corpus_pipeline
from alarmlens.llm import merkle, mixing, packing, quality, simhash, substring_dedup, token_counts, toxicity, variants, warc_zip

SF = "/root/testdata/sf0.001"
_RNG = random.Random(1)
LONG = " ".join(_RNG.choice(["Prose", "with", "ordinary", "words,", "naïve", "中文", "and", "a", "number:"]) + str(k % 977) for k in range(450_000))
WORDS = LONG.split(" ")


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    rows = [(1, LONG, "en", "a", len(LONG)), (2, LONG, "en", "b", len(LONG)), (3, "a short text", "en", "a", 12), (4, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    path = str(tmp_path_factory.mktemp("long") / "docs")
    df.write.parquet(path)
    return spark.read.parquet(path)


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def test_archives(docs):
    got = by_id(warc_zip.round_trip(docs.withColumnsRenamed({"doc_id": "page_id", "text": "html", "source": "url"})), "page_id")
    assert (got[2].payload_digest, got[2].payload_bytes, got[2].record_type) == (hashlib.sha1(LONG.encode()).hexdigest(), len(LONG.encode()), "response")
    assert (got[1].record_type, got[1].refers_to, got[4].payload_bytes) == ("revisit", 2, 0)


def test_counts_and_mixes(docs):
    got = by_id(token_counts.count_tokens(docs))
    assert got[1].n_words == got[2].n_words == len(WORDS) and got[1].n_tokens == got[2].n_tokens > len(WORDS)
    mix = by_id(mixing.mix(docs))
    assert {k: r["size"] for k, r in mix.items()} == {1: len(WORDS), 2: len(WORDS), 3: 3, 4: 0}


def test_scores(docs):
    got = by_id(toxicity.scored(docs, toxicity.ToxicityModel(np.zeros(toxicity.CODES**3, np.float32))))
    assert got[1].score == got[2].score and 0 <= got[1].score <= 1
    got = by_id(quality.scored(docs, quality.train(np.zeros((0, len(quality.STATISTICS))), np.zeros(0))))
    assert got[1].score == got[2].score


def test_duplicates(docs):
    got = by_id(simhash.near_duplicates(docs))
    assert got[1].component_id == got[2].component_id == 1 and got[3].component_id == 3
    got = by_id(substring_dedup.dedup_digest(docs))
    assert got[1].n_removed == got[1].n_words == len(WORDS) and got[3].n_removed == 0


def test_pieces(docs):
    got = [r for r in packing.pack_documents(docs).collect() if r.doc_id == 1]
    starts = sorted((r.start, r.length) for r in got)
    assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:], strict=False)) and len(got) > 500
    assert sum(n for _, n in starts) == len(packing.WordTokenizer(packing.default_tokenizer()).ids(LONG.encode())) // 4 + 1


def test_manifest_and_variants(docs):
    assert {k: r.verified for k, r in by_id(merkle.verified(docs, merkle.disturbed())).items()}.keys() == {1, 2, 3, 4}
    got = {r.word: r.n for r in variants.vocabulary(docs, every=10**12).collect()}
    assert got["prose"] == 2 * sum(w.startswith("Prose") for w in WORDS) and got["naïve"] == 2 * sum(w.startswith("naïve") for w in WORDS)


def test_stages(spark, docs, tmp_path):
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs.write.parquet(str(tmp_path / str(k)))
        docs = stage(spark, spark.read.parquet(str(tmp_path / str(k))), SF)
    got = docs.collect()
    assert {r.doc_id for r in got} >= {1} and all(r.length <= 2048 for r in got)
