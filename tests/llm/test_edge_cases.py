"""Empty tables and columns whose names clash with those that the operators use inside."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from alarmlens.llm import ann, byte_bpe, merkle, mixing, packing, progressive_jpeg, quality, simhash, substring_dedup, token_counts, toxicity, warc_zip

CLASHING = ["_row", "_doc", "id", "text_", "score", "_score", "piece", "length", "size", "list", "query", "bound", "rank", "anchor", "span", "fingerprint", "component_id", "copies", "key", "digest", "n", "largest", "refers_to_"]


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    rows = [(1, "some words of a text", "a"), (2, None, None), (None, "", "a"), (2, "some words of a text", "b"), (2, "some words of a text", "b"), (5, "x " * 400, "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    df = df.withColumns({c: F.lit("mine") for c in CLASHING})
    path = str(tmp_path_factory.mktemp("clash") / "docs")
    df.write.parquet(path)
    return spark.read.parquet(path)


OPERATORS = {
    "op2": lambda d: progressive_jpeg.media_features(d), "op3": lambda d: token_counts.count_tokens(d), "op5": lambda d: mixing.mix(d), "op6": lambda d: substring_dedup.dedup_digest(d),
    "op7": lambda d: toxicity.scored(d, toxicity.ToxicityModel(np.zeros(toxicity.CODES**3, np.float32))),
    "op8": lambda d: quality.scored(d, quality.train(np.zeros((0, len(quality.STATISTICS))), np.zeros(0))), "op9": lambda d: simhash.near_duplicates(d),
    "op11": lambda d: merkle.verified(d.withColumns({"lang": F.lit(None).cast("string"), "n_chars": F.lit(1)}), merkle.disturbed()), "op12": lambda d: byte_bpe.digested(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_for_each(docs, name):
    assert OPERATORS[name](docs).count() == 6
    assert OPERATORS[name](docs.limit(0)).count() == 0


@pytest.mark.parametrize("keep", [substring_dedup.without_repeats, simhash.keep_one_of_each, mixing.mixed])
def test_columns_stay_whole(docs, keep):
    got = keep(docs)
    assert got.columns == docs.columns and {r[c] for r in got.collect() for c in CLASHING} == {"mine"}


def test_pieces_and_archives_of_clashing_tables(docs):
    assert packing.pack_documents(docs).count() == 6
    pages = docs.withColumnsRenamed({"doc_id": "page_id", "text": "html", "source": "url"})
    got = warc_zip.round_trip(pages)
    assert got.count() == 6 and {r.record_type for r in got.collect()} == {"response"}
    assert packing.pack_documents(docs.limit(0)).count() == warc_zip.round_trip(pages.limit(0)).count() == 0


def test_search_beside_clashing_columns(spark):
    rng = np.random.default_rng(0)
    df = spark.createDataFrame([(k, rng.normal(size=4).tolist()) for k in range(45)], "vec_id long, embedding array<double>").withColumns({c: F.lit("mine") for c in CLASHING})
    got = ann.search(df)
    assert got.count() == 3 * 20 and ann.search(df.limit(0)).count() == 0
