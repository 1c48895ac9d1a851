"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only.

Every source has a target in words.  A document's expected copies grow with its propensity (by default the number of bits
of its size, so that of two documents the longer one is the likelier), scaled so that they make up its source's target and
cut at ``most_copies``.  The whole part is certain; the rest is the inclusion probability of one more copy.  Documents are
ranked by the odds of a random number over the odds of that probability, and those of the lowest ranks are taken until the
source's remaining words are reached: an unequal-probability sample whose size is fixed, in words.

The place where a source's ranking is cut is found by histograms: of the ranks' leading bits, then of the next bits within
the one bucket that holds the cut, and so on until that bucket is small; only its rows are ordered.  So no source is ever
ordered as a whole, however large it is.  What is missing at the cut (less than one document) is filled by going on down
the same ranking: each document that is not larger than what is then missing is taken.  Once the documents that may still
fit are few enough in every source, they are walked in order at once; until then, by further histograms.

Row numbers are stored with the sizes (or documents) once, and everything is joined on that stored copy.

Defined results: null text has size 0 and is never taken twice on account of it; a null source is a source, sorted last;
an empty table gives no rows.  The random numbers are hashes of id, text and the seed, so that reruns agree however the table
is read.  Rows that repeat in both share one number: they go in or out together, but for the source's cut among them, and
there the stored row numbers say which; a row's copies are the same whichever of them it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, boxed, materialize, numbered, settled

#: Bits of a rank and of what tells equal ranks apart; bits that one histogram looks at.
RANK_BITS, TIE_BITS, STEP = 36, 12, 12
KEY_BITS = RANK_BITS + TIE_BITS
#: Rows of a bucket that are ordered.
BUCKET_ROWS = 50_000
#: Weights of sources in code point order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD + "+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most_copies: float = 2.0) -> DataFrame:
    """Add ``target`` to (source, source_size), one row per source: ``share`` of all sizes, dealt by weight; a target
    stops at ``most_copies`` times its source's size and the excess is dealt again.

    Water-filling in closed form: in order of size over weight, sources stop for as long as their limit is below their
    part of what the stopped ones leave."""
    order = W.orderBy(F.col("source").isNull(), "source")
    k = (F.row_number().over(order) - 1) % len(weights)
    rows = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (k + 1).cast("int")))
    rows = rows.withColumn("limit", F.lit(float(most_copies)) * F.col("source_size"))
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing).partitionBy()
    rows = rows.withColumn("whole", F.lit(float(share)) * F.sum("source_size").over(everything)).withColumn("weights", F.sum("weight").over(everything))
    up = W.orderBy(F.col("limit") / F.col("weight"), F.col("source").isNull(), "source").rowsBetween(W.unboundedPreceding, -1)
    left = F.col("whole") - F.coalesce(F.sum("limit").over(up), F.lit(0.0))
    level = left / (F.col("weights") - F.coalesce(F.sum("weight").over(up), F.lit(0.0)))
    rows = rows.withColumn("level", level).withColumn("stopped", F.col("limit") <= F.col("level") * F.col("weight"))
    # the first that does not stop sets the level; from there on levels only fall
    free = F.max(F.when(~F.col("stopped"), F.col("level"))).over(everything)
    target = F.when(F.col("stopped"), F.col("limit")).otherwise(F.least(F.col("limit"), free * F.col("weight")))
    return rows.select("source", "source_size", target.alias("target"))


def bits_of(size: Column) -> Column:
    """Number of binary digits: a propensity of few values."""
    return F.length(F.bin(size)).cast("double")


def _scales(sized: DataFrame, targets: DataFrame, propensity: str, most_copies: float) -> DataFrame:
    """(s, scale) of each source: the expected copies are scale times propensity, at most ``most_copies``, and make up the
    target.  Null where every document has the most copies.  Windows run over a source's distinct propensities."""
    classes = sized.groupBy("source", F.col(propensity).alias("p")).agg(F.sum("size").alias("words"))
    classes = materialize(classes.join(targets, classes.source.eqNullSafe(targets.source)).select(targets.source.alias("s"), "target", "p", "words"), "propensities")
    falling = W.partitionBy("s").orderBy(F.desc("p"))
    full = F.coalesce(F.sum("words").over(falling.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) * F.lit(float(most_copies))
    open_ = F.sum(F.col("p") * F.col("words")).over(falling.rowsBetween(W.currentRow, W.unboundedFollowing))
    scale = F.try_divide(F.col("target") - full, open_)
    tried = classes.withColumn("scale", scale).filter(F.col("scale") * F.col("p") < most_copies)
    return tried.groupBy("s").agg(F.max_by("scale", "p").alias("scale"))


def _cuts(rows: DataFrame, room: DataFrame) -> DataFrame:
    """Where the rankings of ``rows`` (source, key, size) exceed the ``room`` (s, room) of their sources: (s, shift,
    prefix, room): keys with lesser leading bits fit, those with these bits have ``room`` among them.  Sources that fit
    as a whole have no row."""
    cuts = room.select("s", F.lit(KEY_BITS).alias("shift"), F.lit(0).cast("long").alias("prefix"), F.greatest(F.col("room").cast("double"), F.lit(0.0)).alias("room"))
    for shift in range(KEY_BITS - STEP, -1, -STEP):
        inside = rows.join(cuts, F.col("source").eqNullSafe(F.col("s")) & F.expr("shiftright(key, shift) = prefix"))
        # stored before the window, so that what a source sends there is one row a bucket
        buckets = materialize(inside.groupBy("s", "room", F.shiftright("key", shift).alias("bucket")).agg(F.sum("size").alias("words"), F.count("*").alias("n")), "buckets")
        upto = F.sum("words").over(W.partitionBy("s").orderBy("bucket"))
        cut = buckets.withColumn("upto", upto).filter((F.col("upto") > F.col("room")) & (F.col("upto") - F.col("words") <= F.col("room")))
        cut = materialize(cut.select("s", F.lit(shift).alias("shift"), F.col("bucket").alias("prefix"), (F.col("room") - F.col("upto") + F.col("words")).alias("room"), "n"), "cuts")
        cuts = cut.drop("n")
        if (cut.agg(F.max("n")).first()[0] or 0) <= BUCKET_ROWS:
            break
    return cuts


def _fill(rows: DataFrame, room: DataFrame, id_col: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """One pass down the ranking of ``rows`` (source, id, _row, key, size): the cuts; the numbers of the rows in cut
    buckets that fit; and the rows behind the cut that fit into what is then left, with it as ``room`` (s, room)."""
    cuts = _cuts(rows, room)
    placed = rows.join(cuts, F.col("source").eqNullSafe(F.col("s")))
    at = F.expr("shiftright(key, shift)")
    inside = placed.filter(at == F.col("prefix"))
    inside = materialize(inside.withColumn("filled", F.sum("size").over(W.partitionBy("source").orderBy("key", id_col, "_row").rowsBetween(W.unboundedPreceding, 0))), "inside")
    fits = inside.filter(F.col("filled") <= F.col("room"))
    got = fits.groupBy("source").agg(F.max("filled").alias("got"))
    left = cuts.join(got, F.col("s").eqNullSafe(F.col("source")), "left").select("s", (F.col("room") - F.coalesce("got", F.lit(0))).alias("room"))
    left = materialize(left, "left")
    behind = placed.filter(at > F.col("prefix")).select(*rows.columns).union(inside.filter(F.col("filled") > F.col("room")).select(*rows.columns))
    behind = behind.join(left, F.col("source").eqNullSafe(F.col("s"))).filter((F.col("size") <= F.col("room")) & (F.col("size") > 0))
    return cuts, fits.select("_row"), materialize(behind.select(*rows.columns), "behind"), left


def _walked(rows: DataFrame, room: DataFrame, id_col: str) -> DataFrame:
    """Numbers of the ``rows`` (source, id, _row, key, size), at most ``BUCKET_ROWS`` a source, that are taken on a walk down
    the ranking: each that fits into what is left of the ``room`` (s, room)."""
    met = rows.join(room, F.col("source").eqNullSafe(F.col("s")))
    lists = met.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("key", F.col(id_col).alias("id"), "_row", "size"))).alias("ranking"), F.first("room").alias("room"))
    start = F.struct(F.col("room").alias("room"), F.array().cast("array<bigint>").alias("taken"))
    step = lambda at, x: F.when(x["size"] <= at["room"], F.struct((at["room"] - x["size"]).alias("room"), F.array_append(at["taken"], x["_row"]).alias("taken"))).otherwise(at)
    return lists.select(F.explode(F.aggregate("ranking", start, step)["taken"]).alias("_row"))


def sample_copies(sized: DataFrame, targets: DataFrame, id_col: str, seed: int = 17, most_copies: float = 2.0, propensity: str | None = None, draw: str | None = None) -> DataFrame:
    """``sized`` (_row, id, source, size[, propensity, draw]), a written table, with ``source_size``, ``target`` and
    ``copies``.  A propensity takes few values; ``draw`` is what the random numbers are drawn by, else the id."""
    base = sized.withColumn("_p", F.col(propensity) if propensity else F.lit(1.0))
    scales = materialize(_scales(base, targets, "_p", most_copies), "scales")
    rows = base.join(targets.withColumnRenamed("source", "_of"), F.col("source").eqNullSafe(F.col("_of"))).join(scales, F.col("source").eqNullSafe(F.col("s")), "left").drop("_of", "s")
    expected = F.when(F.col("source_size") > 0, F.least(F.coalesce(F.col("scale") * F.col("_p"), F.lit(float(most_copies))), F.lit(float(most_copies)))).otherwise(F.lit(0.0))
    rows = rows.withColumn("expected", expected).withColumn("sure", F.floor("expected")).withColumn("part", F.col("expected") - F.col("sure"))
    # 52 bits of a hash as a number in (0, 1)
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(draw or id_col)), 12).cast("double") + 0.5) / float(1 << 52)
    # odds over odds, as a number in (0, 1) that grows with it
    rank = F.when(F.col("part") > 0, u * (1 - F.col("part")) / (u * (1 - F.col("part")) + (1 - u) * F.col("part"))).otherwise(F.lit(1.0))
    high = F.least(F.floor(rank * float(1 << RANK_BITS)), F.lit((1 << RANK_BITS) - 1)).cast("long")
    rows = rows.withColumn("key", F.shiftleft(high, TIE_BITS).bitwiseOR(F.xxhash64(F.lit(seed + 1), F.col(draw or id_col)).bitwiseAND((1 << TIE_BITS) - 1)))
    rows = materialize(rows.select(*sized.columns, "source_size", "target", "sure", "part", "key"), "ranked")
    room = rows.groupBy(F.col("source").alias("s")).agg((F.first("target") - F.sum(F.col("sure") * F.col("size"))).alias("room"))
    open_ = rows.filter("part > 0").select("source", id_col, "_row", "key", "size")
    cuts, extra, behind, left = _fill(open_, materialize(room, "room"), id_col)
    while (behind.groupBy("source").count().agg(F.max("count")).first()[0] or 0) > BUCKET_ROWS:
        more, fits, behind_next, left = _fill(behind, left, id_col)
        whole = behind.join(more, F.col("source").eqNullSafe(F.col("s")), "left").filter(F.col("prefix").isNull() | F.expr("shiftright(key, shift) < prefix"))
        extra, behind = extra.union(fits).union(whole.select("_row")), behind_next
    extra = extra.union(_walked(behind, left, id_col))
    extra = materialize(extra.select(F.col("_row").alias("r"), F.lit(True).alias("filled_in")), "at-the-cut")
    rows = rows.join(cuts, F.col("source").eqNullSafe(F.col("s")), "left").join(extra, F.col("_row") == F.col("r"), "left")
    # a source without a cut takes every further copy there is
    below = F.col("prefix").isNull() | F.expr("shiftright(key, shift) < prefix")
    more = F.when((F.col("part") > 0) & (below | F.col("filled_in")), 1).otherwise(0)
    return rows.select(*sized.columns, "source_size", "target", (F.col("sure") + more).cast("int").alias("copies"))


def _mixed_sizes(sized: DataFrame, weights: tuple[float, ...], share: float, most_copies: float, seed: int) -> DataFrame:
    """``sized``: (_row, id, source, size, draw), a written table."""
    sizes = materialize(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "source-sizes")
    targets = materialize(source_targets(sizes, weights, share, most_copies), "targets")
    rows = sized.withColumn("propensity", bits_of(F.col("size")))
    return sample_copies(rows, targets, "id", seed, most_copies, "propensity", "draw").drop("propensity", "draw")


def _sized(prefix: str, id_col: str, text_col: str, source_col: str) -> list[Column]:
    i, text, source = (F.col(f"{prefix}`{c}`") for c in (id_col, text_col, source_col))
    return [i.alias("id"), source.alias("source"), word_count(text).alias("size"), F.xxhash64(i, text).alias("draw")]


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most_copies: float = 2.0, seed: int = 17) -> DataFrame:
    """One row per document: _row, id, source, size, source_size, target, copies."""
    sized = numbered(docs.select(*_sized("", id_col, text_col, source_col)), "sizes")
    return _mixed_sizes(sized, weights, share, most_copies, seed).withColumnRenamed("id", id_col)


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most_copies: float = 2.0, seed: int = 17) -> DataFrame:
    """The documents of the mix: each as often as it is taken."""
    keyed = numbered(boxed(docs), "documents")

    def taken() -> DataFrame:
        sized = materialize(keyed.select(*_sized("_doc.", id_col, text_col, source_col), "_row"), "sizes")
        return _mixed_sizes(sized, weights, share, most_copies, seed).filter("copies > 0").select("_row", F.col("copies").alias("_copies"))

    rows = keyed.join(settled(docs.sparkSession, "copies", taken), "_row")
    return rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select("_doc.*")
