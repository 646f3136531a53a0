"""Mixing sources to target weights along a time-varying curriculum.

Targets.  Sources in code-point order, null last, weigh 5, 2, 1, repeating.
They share the words of all documents by weight; a target stops at `most`
(3) times its source's words and the excess is shared again by weight until
none is above: the water level L with sum(min(3 * size, L * weight)) = total.

Amounts.  A source's documents stand in a fixed pseudo-random order (a hash of
id, text and source) and are read round and round until the target is reached, so a
document is taken whole once for every full pass and for the part of the last
pass that lies before the end; one document a source is cut there.

Positions.  A source's weight runs in training time t of 0 to 1 as
1 + slope * (2 t - 1); its integral t + slope * (t * t - t) is inverted at the
share of the target that stands before a document, which gives its position.
Documents are range-sorted by position.

Prefix sums over a source run in `buckets` of its hash order, then over the
buckets, so no task holds a source, however hot.

Cases: null or blank texts have size 0 and are taken 0 times; null source is a
source of its own; repeated rows are separate documents; without words all
targets are 0; an empty table gives no rows; extra columns are kept out by name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut

WEIGHTS = (5.0, 2.0, 1.0)
#: Slopes of the weight schedules, by the source's place, repeating: later, earlier, even.
SLOPES = (0.8, -0.8, 0.0)


def sizes(documents: DataFrame) -> DataFrame:
    """doc_id, source, size in words, and the place in the fixed order: bucket and rank hash."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return documents.select("doc_id", "source", size.alias("size"), F.xxhash64("doc_id", "text", "source").alias("rank"))


def source_targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, slopes: tuple[float, ...] = SLOPES, most: float = 3.0) -> DataFrame:
    """source, source_size, target, slope: one row a source."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.col("place") % len(values) + 1).cast("int"))
    per = per.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    per = per.withColumn("weight", pick(weights)).withColumn("slope", pick(slopes)).withColumn("limit", F.lit(most) * F.col("source_size"))
    first_full = Window.orderBy(F.col("limit") / F.col("weight"), "place")
    before, behind = first_full.rowsBetween(Window.unboundedPreceding, -1), first_full.rowsBetween(0, Window.unboundedFollowing)
    level = (F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("weight").over(behind)
    per = per.withColumn("level", level)
    # the first source in this order that the level of all sources from it on doesn't fill gives the water level
    water = F.min(F.when(F.col("level") * F.col("weight") <= F.col("limit"), F.struct(F.col("limit") / F.col("weight"), "place", "level"))).over(Window.partitionBy())["level"]
    return per.select("source", "source_size", F.least(F.col("limit"), F.coalesce(water * F.col("weight"), F.col("limit"))).alias("target"), "slope")


def _inverse(share: Column, slope: Column) -> Column:
    """The t with t + slope * (t * t - t) = share."""
    straight = F.lit(1.0) - slope
    return F.when(F.abs(slope) < 1e-9, share).otherwise((F.sqrt(straight * straight + F.lit(4.0) * slope * share) - straight) / F.when(slope == 0, F.lit(1.0)).otherwise(F.lit(2.0) * slope))


def mix(documents: DataFrame, bucket_rows: int = 4096) -> DataFrame:
    """doc_id, source, rank, size, source_size, target, slope, start, taken, passes, rest, position.

    taken = passes * size + rest words; start is the words before the document in its source's order;
    position is that of its first pass, null where nothing is taken.
    `bucket_rows` sets only how finely prefix sums are divided, never the result.
    """
    sized = cut(sizes(documents), "mix-sizes")
    spread = max(1, -(-sized.count() // bucket_rows))
    sized = sized.withColumn("bucket", F.floor((F.shiftrightunsigned("rank", 1) / F.lit(float(1 << 63))) * spread))
    targets = source_targets(sized)
    in_order = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = sized.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size")).withColumn("bucket_start", F.coalesce(F.sum("bucket_size").over(in_order), F.lit(0)))
    buckets = buckets.join(targets.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).select(F.col("source").alias("of"), F.col("bucket").alias("b"), "bucket_start", "source_size", "target", "slope")
    within = Window.partitionBy("source", "bucket").orderBy(F.shiftrightunsigned("rank", 1), "rank", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("start", F.coalesce(F.sum("size").over(within), F.lit(0)))
    placed = placed.join(buckets, F.col("source").eqNullSafe(F.col("of")) & (F.col("bucket") == F.col("b")))
    words = F.floor("target")
    placed = placed.withColumn("start", F.col("start") + F.col("bucket_start")).withColumn("passes", F.when(F.col("size") > 0, F.floor(words / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    placed = placed.withColumn("rest", F.greatest(F.lit(0), F.least(F.col("size"), words - F.col("passes") * F.col("source_size") - F.col("start"))).cast("long"))
    placed = placed.withColumn("taken", F.col("passes") * F.col("size") + F.col("rest"))
    placed = placed.withColumn("position", F.when(F.col("taken") > 0, position(F.col("start"))))
    return placed.select("doc_id", "source", "rank", "size", "source_size", "target", "slope", "start", "taken", "passes", "rest", "position")


def position(demand: Column) -> Column:
    """Training time at which a source's mix has taken `demand` words."""
    return _inverse(F.least(F.lit(1.0), demand / F.greatest(F.col("target"), F.lit(1.0))), F.col("slope"))


def in_training_order(rows: DataFrame) -> DataFrame:
    """Range-sorted by position."""
    return rows.repartitionByRange("position", "rank").sortWithinPartitions("position", "rank")


def mixed_documents(documents: DataFrame) -> DataFrame:
    """The mix as documents in training order: a row for each pass; where a source's target ends inside a document, the words up to there."""
    plan = mix(documents).where("taken > 0").drop("source", "taken", "position")
    passes = F.sequence(F.lit(0).cast("long"), F.col("passes") - (F.col("rest") == 0).cast("long"))
    plan = plan.withColumn("pass", F.explode(passes)).withColumn("position", position(F.col("pass") * F.col("source_size") + F.col("start")))
    plan = plan.select("rank", "position", F.when((F.col("pass") == F.col("passes")) & (F.col("rest") < F.col("size")), F.col("rest")).alias("words"))
    own = documents.select(F.struct(*documents.columns).alias("row"), F.xxhash64("doc_id", "text", "source").alias("key"))
    # rows of one id, text and source have a place in the plan each, and the first by its other columns stands for them
    own = own.withColumn("other", F.xxhash64("row")).groupBy("key").agg(F.min_by("row", "other").alias("row"))
    rows = in_training_order(own.join(plan, F.col("key") == F.col("rank")).select("row", "rank", "position", "words"))
    rows = rows.select("row.*", F.col("words").alias("__words"))
    behind = F.element_at(F.split("text", r"(?<=[^\x20\x09-\x0D])[\x20\x09-\x0D]+", (F.col("__words") + 1).cast("int")), -1)
    cut_text = F.regexp_replace(F.col("text").substr(F.lit(1), F.length("text") - F.length(behind)), r"[\x20\x09-\x0D]+$", "")
    rows = rows.withColumn("text", F.when(F.col("__words").isNotNull(), cut_text).otherwise(F.col("text")))
    if "n_chars" in documents.columns:
        rows = rows.withColumn("n_chars", F.length("text").cast(documents.schema["n_chars"].dataType))
    return rows.select(*documents.columns)
