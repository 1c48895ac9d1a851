"""Registered queries of the operators in this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, byte_bpe, merkle, mixing, packing, progressive_jpeg, quality, simhash, substring_dedup, token_counts, toxicity, variants, warc_zip
from .common import table


def op1_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_zip.round_trip(table(spark, sf_dir, "pages"))


def op2_progressive_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return progressive_jpeg.media_features(table(spark, sf_dir, "documents"))


def op3_trie_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_words", "n_tokens")


def op4_adaptive_dimension_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"))


def op5_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "copies")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup_digest(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    rows = toxicity.scored(docs.select("doc_id", "text"), model)
    return rows.select("doc_id", toxicity.held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op8_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    trees = quality.fit(docs, table(spark, sf_dir, "labels"))
    rows = quality.scored(docs.select("doc_id", "text"), trees)
    return rows.select("doc_id", toxicity.held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op9_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verified(table(spark, sf_dir, "documents"), merkle.disturbed())


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digested(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.spelling_variants(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_warc_zip, op2_progressive_jpeg, op3_trie_token_counts, op4_adaptive_dimension_search, op5_pareto_mix, op6_substring_dedup, op7_toxicity,
        op8_quality_trees, op9_simhash_components, op10_best_fit_packing, op11_merkle_manifest, op12_byte_bpe, op13_spelling_variants,
    )
}

#: crc32 of an ASCII text, bit by bit
_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, octet_length(encode({0})) + 1), lambda k: ascii(({0})[k])::BIGINT)), lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)), lambda c, i: xor(c >> 1, 3988292384 * (c & 1)))), 4294967295)"


def _merkle_sql(below: int = 5, above: int = 2) -> str:
    """Trees of up to 16^below leaves a source and 16^above sources, level by level."""
    field = "CASE WHEN {0} IS NULL THEN '-' ELSE octet_length(encode({0}::VARCHAR)) || ':' || {0} END"
    of = lambda text: "sha256(" + " || ".join(field.format(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    changed = of(lower)
    ctes = [
        f"leaves AS (SELECT doc_id, coalesce('s' || source, '') AS tree, {of('text')} AS leaf, coalesce({_CRC.format('doc_id::VARCHAR')} % 5 = 0, false) AS hit, {changed} AS changed FROM documents)",
        "leaf_rows AS (SELECT *, row_number() OVER () AS r, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM leaves)",
        "n0 AS (SELECT tree, i, leaf AS node FROM leaf_rows)", "f0 AS (SELECT r, tree, i, '' AS path, CASE WHEN hit THEN changed ELSE leaf END AS folded FROM leaf_rows)",
    ]
    for k in range(below + above):
        if k == below:  # subroots are the nodes of one tree now
            ctes += [f"subroots AS (SELECT tree, node, row_number() OVER (ORDER BY tree) - 1 AS i FROM n{k})", "top AS (SELECT '' AS tree, i, node FROM subroots)", f"entered AS (SELECT r, '' AS tree, s.i, path, folded FROM f{k} f JOIN subroots s USING (tree))"]
        n, f = ("top", "entered") if k == below else (f"n{k}", f"f{k}")
        run = "PARTITION BY tree, i // 16 ORDER BY i ROWS BETWEEN"
        ctes += [
            f"s{k} AS (SELECT *, count(*) OVER (PARTITION BY tree) > 1 AS more, coalesce(string_agg(node, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS a, coalesce(string_agg(node, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS b FROM {n})",
            f"n{k + 1} AS (SELECT tree, i // 16 AS i, CASE WHEN bool_or(more) THEN sha256(string_agg(node, '' ORDER BY s.i)) ELSE max(node) END AS node FROM s{k} s GROUP BY tree, s.i // 16)",
            f"f{k + 1} AS (SELECT r, tree, f.i // 16 AS i, CASE WHEN more THEN path || a || b ELSE path END AS path, CASE WHEN more THEN sha256(a || folded || b) ELSE folded END AS folded FROM {f} f JOIN s{k} USING (tree, i))",
        ]
    last = below + above
    return f"""WITH {", ".join(ctes)}
SELECT doc_id, leaf, subroots.node AS subroot, t.node AS root, sha256(path) AS proof_sha256, folded AS folded_root, folded = t.node AS verified
FROM leaf_rows JOIN f{last} USING (r) JOIN subroots ON subroots.tree = leaf_rows.tree CROSS JOIN n{last} t"""


_VARIANTS_SQL = f"""
WITH runs AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]+')) AS run FROM documents)),
counted AS (SELECT doc_id, run, count(*) AS n, [ascii(x)::BIGINT FOR x IN string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, '')] AS points FROM runs GROUP BY doc_id, run),
hashed AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten([CASE WHEN p < 128 THEN [p] ELSE [192 + (p >> 6), 128 + (p & 63)] END FOR p IN points])), lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)), lambda c, i: xor(c >> 1, 3988292384 * (c & 1)))), 4294967295) AS h FROM counted),
words AS (SELECT word, sum(n)::BIGINT AS n FROM (SELECT CASE WHEN h % 97 = 0 THEN left(run, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, n FROM hashed) WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
cut AS (SELECT DISTINCT word, n, k, left(word, k) || substr(word, k + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS k FROM words)),
near AS (SELECT DISTINCT word, other, m FROM (SELECT a.word, b.word AS other, b.n AS m FROM cut a JOIN cut b ON a.rest = b.rest AND a.k = b.k AND a.word <> b.word
  UNION ALL SELECT c.word, w.word, w.n FROM cut c JOIN words w ON w.word = c.rest UNION ALL SELECT w.word, c.word, c.n FROM cut c JOIN words w ON w.word = c.rest)),
best AS (SELECT word, count(*) AS n_near, arg_min(other, (-m, other)) AS other, max(m) AS m FROM near GROUP BY word),
forms AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * n THEN other END AS form, CASE WHEN m >= 2 * n THEN m END AS form_n FROM words LEFT JOIN best USING (word)),
roots AS (WITH RECURSIVE up AS (SELECT word, word AS here FROM words UNION ALL SELECT up.word, form FROM up JOIN forms ON forms.word = up.here WHERE form IS NOT NULL) SELECT up.word, here AS root FROM up JOIN forms ON forms.word = up.here WHERE form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN roots USING (word)"""

ORACLES: dict[str, str] = {
    "op1_warc_zip": """
SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest,
  CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN last END AS refers_to, coalesce(url, '') AS uri
FROM (SELECT *, octet_length(encode(coalesce(html, ''))) >= 1000 AND page_id <> last AS again
      FROM (SELECT *, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last FROM pages))""",
    "op6_substring_dedup": r"""
WITH docs AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
windows AS (SELECT r, p, md5(array_to_string(list_slice(ws, p, p + 34), ' ')) AS k FROM (SELECT r, ws, unnest(range(1, len(ws) - 33)) AS p FROM docs WHERE len(ws) >= 35)),
repeated AS (SELECT r, p FROM (SELECT r, p, count(*) OVER (PARTITION BY k) AS c FROM windows) WHERE c > 1),
words AS (SELECT r, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM docs),
marked AS (SELECT w.r, w.p, word, count(x.p) OVER (PARTITION BY w.r ORDER BY w.p ROWS 34 PRECEDING) > 0 AS gone FROM words w LEFT JOIN repeated x ON x.r = w.r AND x.p = w.p)
SELECT doc_id, len(ws) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM docs LEFT JOIN (SELECT r, count(*) FILTER (WHERE gone) AS n_removed, string_agg(word, ' ' ORDER BY p) FILTER (WHERE NOT gone) AS kept FROM marked GROUP BY r) USING (r)""",
    "op11_merkle_manifest": _merkle_sql(),
    "op13_spelling_variants": _VARIANTS_SQL,
}
