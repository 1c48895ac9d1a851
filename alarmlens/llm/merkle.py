"""A Merkle manifest of a dataset: a content-addressed DAG, and proofs by descent from its root.

A row's leaf is the digest of its columns, each as byte count, colon and value.  Leaves of a source stand in the order of
their ids; runs of ``FANOUT`` neighbours become the digest of their digests until one is left, the source's subroot; subroots
in the order of their sources become the root in the same way.  What is stored of every node is one record, digest to
children; equal subtrees have equal records.

A leaf's request is its rank, whose digits to the base ``FANOUT`` say which child to take at each level.  Requests descend
together: one row for each node of a level, joined with the records by digest, goes on to the chosen child and takes along
the children that were not chosen (those to the left and those to the right, a segment of the path).  So a level costs as
many rows as it has nodes, and the rows above the leaves hold the path of up to ``FANOUT`` requests each.  At the leaf the
segments are reversed, which gives the siblings from the leaf up to the root.

Ranks come from a range sort: rows are dealt and sorted by (source, id, leaf), stored with their place, and counted for each
source and part; only these counts meet in a window.  So a source, and even one repeated row, may hold any share of the
rows.  Texts are hashed where they are read and never shuffled.

Defined results: a null in any column is ``-``; null ids come first and are never tampered with; of equal ids the lesser
leaf comes first, and repeated rows are leaves of their own with a proof each; a lone leaf is its source's subroot, and a
lone subroot the root; with no siblings at all the proof is the digest of nothing; an empty table gives no rows; further
columns, whatever their names, take no part.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize

FANOUT, SHIFT = 16, 4
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def encoded(c: Column) -> Column:
    text = c.cast("string")
    return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaves(docs: DataFrame, tampered: Column | None = None, columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """(tree, id, leaf, found): of each row its source as a text that is not null, its leaf, and the leaf of what is found
    of it now: another where ``tampered`` holds and the text has capitals to lose.  The first column is the id, the second
    the source, the last the text."""
    ident, source, *others, text = [F.col(f"`{c}`") for c in columns]
    of = lambda *cols: F.sha2(F.concat(*[encoded(c) for c in cols]), 256)
    whole, changed = of(ident, source, *others, text), of(ident, source, *others, F.translate(text, UPPER, LOWER))
    tree = F.when(source.isNull(), F.lit("")).otherwise(F.concat(F.lit("s"), source.cast("string")))
    touched = F.lit(False) if tampered is None else F.coalesce(tampered, F.lit(False))
    rows = docs.select(tree.alias("tree"), ident.alias("id"), whole.alias("leaf"), F.when(touched, changed).alias("changed"))
    return rows.select("tree", "id", "leaf", F.coalesce("changed", "leaf").alias("found"))


def ranked(rows: DataFrame, by: list[str], order: list[str], name: str) -> DataFrame:
    """``rows``, stored, with ``rank`` from 0 among rows of equal ``by`` and their number ``of``.

    Rows that are equal in all of these are dealt apart by their place in the scan: which of them comes first makes no
    difference."""
    keys = [F.col(c).asc_nulls_first() for c in [*by, *order, "_scan"]]
    dealt = rows.withColumn("_scan", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_scan")
    place = F.monotonically_increasing_id()
    dealt = materialize(dealt.withColumn("_part", F.shiftright(place, 33)).withColumn("_place", place.bitwiseAND(F.lit((1 << 33) - 1))), name)
    parts = dealt.groupBy("_part", *by).agg(F.min("_place").alias("_first"), F.count("*").alias("_n"))
    group = W.partitionBy(*by)  # a row for each part of a group
    before = F.coalesce(F.sum("_n").over(group.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("_part", *by, (before - F.col("_first")).alias("_shift"), F.sum("_n").over(group).alias("of"))
    return dealt.join(parts, ["_part", *by]).select(*rows.columns, (F.col("_place") + F.col("_shift")).alias("rank"), "of")


def grown(nodes: DataFrame, name: str) -> tuple[list[DataFrame], DataFrame]:
    """Of ``nodes`` (tree, rank, node, of): the records (tree, rank, node, of, children) of each level above, lowest
    first, and the top (tree, node, height) of each tree."""
    most = nodes.agg(F.max("of")).first()[0] or 0
    levels: list[DataFrame] = []
    at, span = nodes, 1
    tops = []
    while True:
        alone = F.col("of") <= span
        tops.append(at.filter(alone).select("tree", "node", F.lit(len(levels)).alias("height")))
        if span >= most:
            return levels, reduce(DataFrame.unionByName, tops)
        # a run has FANOUT nodes at most
        run = F.array_sort(F.collect_list(F.struct("rank", "node")))["node"].alias("children")
        made = at.filter(~alone).groupBy("tree", "of", F.shiftright("rank", SHIFT).alias("rank")).agg(run)
        levels.append(materialize(made.withColumn("node", F.sha2(F.concat_ws("", "children"), 256)), f"{name}-level"))
        at, span = levels[-1].select("tree", "rank", "node", "of"), span * FANOUT


@dataclass
class Manifest:
    leaves: DataFrame  # tree, id, leaf, found, rank, of
    below: list[DataFrame]  # records of the sources' trees, a table for each level, lowest first
    sources: DataFrame  # tree, node (the subroot), height, rank
    above: list[DataFrame]  # records of the tree above the subroots
    root: str | None  # None: no rows


def manifest(rows: DataFrame) -> Manifest:
    """Of ``leaves``."""
    stored = ranked(rows, ["tree"], ["id", "leaf", "found"], "leaves")
    below, tops = grown(stored.select("tree", "rank", F.col("leaf").alias("node"), "of"), "source")
    sources = ranked(tops, [], ["tree"], "subroots")
    above, top = grown(sources.select(F.lit("").alias("tree"), "rank", "node", "of"), "top")
    root = top.first()
    return Manifest(stored, below, sources.drop("of"), above, root and root["node"])


def segment(children: Column, digit: Column) -> Column:
    """The children before and after one, each as one text."""
    before, after = F.slice(children, F.lit(1), digit), F.slice(children, digit + 2, F.size(children))
    return F.struct(F.concat_ws("", before).alias("left"), F.concat_ws("", after).alias("right"))


def met(requests: DataFrame, records: DataFrame) -> DataFrame:
    """``requests`` with the children of their node."""
    return requests.join(records.select("node", "children").dropDuplicates(["node"]), "node")


def descended(requests: DataFrame, records: DataFrame) -> DataFrame:
    """One step down from the ``node`` of each request (rank, path, ...) to each of its children."""
    found = met(requests, records).select("*", F.posexplode("children").alias("digit", "child"))
    path = F.array_append("path", segment(F.col("children"), F.col("digit"))).alias("path")
    kept = [c for c in requests.columns if c not in ("node", "rank", "path")]
    return found.select(*kept, F.col("child").alias("node"), (F.shiftleft("rank", SHIFT) + F.col("digit")).alias("rank"), path)


def proofs(m: Manifest) -> DataFrame:
    """(id, leaf, found, subroot, path): each leaf's segments (left, right) from the leaf up to the root."""
    spark = m.leaves.sparkSession
    at = spark.createDataFrame([] if m.root is None else [(m.root, 0, [])], "node string, rank long, path array<struct<left:string,right:string>>")
    for records in reversed(m.above):
        at = materialize(descended(at, records), "descent")
    trees = m.sources.select("tree", "height", "rank", F.col("node").alias("subroot"))
    entering = at.join(trees, "rank").select("tree", "subroot", "height", "node", F.lit(0).cast("long").alias("rank"), "path")
    at = entering.filter(F.col("height") == len(m.below)) if m.below else None
    for level in range(len(m.below) - 1, 0, -1):  # requests at the nodes of level + 1 go down to those of level
        at = materialize(descended(at, m.below[level]), "descent").unionByName(entering.filter(F.col("height") == level))
    asked = m.leaves.withColumn("run", F.shiftright("rank", SHIFT)).withColumn("digit", F.col("rank").bitwiseAND(F.lit(FANOUT - 1)).cast("int"))
    lone = asked.join(entering.filter("height = 0").select("tree", "subroot", "path"), "tree").select("id", "leaf", "found", "subroot", F.reverse("path").alias("path"))
    if at is None:
        return lone
    runs = met(at, m.below[0]).select("tree", "subroot", F.col("rank").alias("run"), "children", "path")
    path = F.reverse(F.array_append("path", segment(F.col("children"), F.col("digit"))))
    return lone.unionByName(asked.join(runs, ["tree", "run"]).select("id", "leaf", "found", "subroot", path.alias("path")))


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the segments of its path give."""
    return F.aggregate(path, leaf, lambda node, s: F.sha2(F.concat(s["left"], node, s["right"]), 256))


def verified(docs: DataFrame, tampered: Column | None = None, columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """One row for each row of ``docs``: id, leaf, subroot, root, proof_sha256, folded_root, verified."""
    m = manifest(leaves(docs, tampered, columns))
    siblings = F.concat_ws("", F.transform("path", lambda s: F.concat(s["left"], s["right"])))
    out = proofs(m).select(
        F.col("id").alias(columns[0]), "leaf", "subroot", F.lit(m.root).cast("string").alias("root"), F.sha2(siblings, 256).alias("proof_sha256"),
        folded(F.col("found"), F.col("path")).alias("folded_root"),
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def disturbed(id_col: str = "doc_id") -> Column:
    """Rows to tamper with: one id in five, by the checksum of its decimal."""
    return F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 5 == 0
