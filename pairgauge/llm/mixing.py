"""Mixing sources to target token weights by entropy balancing, rounded into whole copies.

The rates nearest to 1 in token-weighted relative entropy that meet one token constraint per source
are exp(lambda of the source). The dual, sum of size * exp(lambda) - lambda * target, is convex and
its Hessian diagonal in the sources, so a source's token sum is all that a Newton step needs: the steps
run on the table of sources, every source in parallel, until they stand still.

Rates are rounded into copies without a pass over a whole source in one task. A source's documents stand
in the order of a hash; 4096 hash buckets are summed first, so only the bucket in which the quota of
extra copies ends is ordered row by row. One more document, the one whose size is nearest to what is
still missing, closes the gap. Only built-in functions run.

Defined cases: a null text has size 0 and a document of size 0 takes nothing; a null source is one
source, the last; repeated rows are mixed one by one; a source without words has target 0; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import picked, stored

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST_COPIES = 2
NEWTON_STEPS = 64
BUCKET_BITS = 12


def word_count(text: Column) -> Column:
    """Number of runs of anything but ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t-\r]+")), F.lit(0)).cast("bigint")


def targets(
    sources: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    share: float = SHARE,
    most: float = MOST_COPIES,
) -> DataFrame:
    """Adds ``target`` to a table (source, source_size) with one row per source.

    Weights repeat over the sources by code point, null last. The common level of target per weight is
    the largest of the levels that arise when the sources with the least room per weight are taken out
    at their limit one after the other.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(
        F.array(*[F.lit(w) for w in weights]), F.pmod(F.row_number().over(by_name) - 1, len(weights)) + 1
    )
    room = F.col("source_size") * F.lit(float(most))
    rows = sources.withColumn("weight", weight).withColumn("room", room)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    earlier = Window.orderBy(F.col("room") / F.col("weight"), F.col("source").asc_nulls_last())
    earlier = earlier.rowsBetween(Window.unboundedPreceding, -1)
    wanted = F.sum("source_size").over(every) * F.lit(float(share))
    before = F.coalesce(F.sum("room").over(earlier), F.lit(0.0))
    gone = F.coalesce(F.sum("weight").over(earlier), F.lit(0.0))
    level = (wanted - before) / (F.sum("weight").over(every) - gone)
    rows = rows.withColumn("level", level).withColumn("level", F.max("level").over(every))
    return rows.withColumn("target", F.least("room", F.col("level") * F.col("weight"))).drop(
        "level", "room"
    )


def newton(size: Column, target: Column, steps: int = NEWTON_STEPS) -> Column:
    """The dual variable of each source: lambda with size * exp(lambda) = target, by Newton steps."""
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(steps)),
        F.lit(0.0),
        lambda tilt, _: tilt - (size * F.exp(tilt) - target) / (size * F.exp(tilt)),
    )


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = WEIGHTS,
    share: float = SHARE,
    most: int = MOST_COPIES,
) -> DataFrame:
    """doc_id, source, size, source_size, weight, target, rate, copies and taken of every document.

    ``row`` and ``place`` say which of several equal rows is meant; they come from the stored sizes.
    """
    texts = picked(docs, doc_id=id_col, text=text_col, source=source_col)
    rows = stored(
        texts.select(
            "doc_id",
            "source",
            word_count(F.col("text")).alias("size"),
            F.xxhash64("doc_id", "text").alias("place"),
            F.monotonically_increasing_id().alias("row"),
        )
    )
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    size, target = F.col("source_size").cast("double"), F.col("target")
    tilt = F.when((size > 0) & (target > 0), newton(size, target))
    rated = targets(sums, weights, share, float(most)).withColumn("tilt", tilt)
    rated = rated.withColumn("rate", F.coalesce(F.exp("tilt"), F.lit(0.0)))
    whole = F.least(F.floor(F.col("rate") + 1e-9), F.lit(most)).cast("bigint")
    rated = rated.withColumn("whole", whole).withColumn(
        "quota", F.greatest(F.col("target") - F.col("whole") * F.col("source_size"), F.lit(0.0))
    )
    rated = stored(rated)

    bucket = F.shiftrightunsigned(F.col("place"), 64 - BUCKET_BITS)
    rows = rows.withColumn("bucket", bucket)
    filled = rows.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    order = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    filled = filled.withColumn("below", F.coalesce(F.sum("bucket_size").over(order), F.lit(0)))
    same = rated.select(F.col("source").alias("its"), "quota")
    filled = filled.join(same, F.col("source").eqNullSafe(F.col("its"))).drop("its")
    full = F.col("below") + F.col("bucket_size") <= F.col("quota")
    state = F.when(full, 1).when(F.col("below") < F.col("quota"), 0)
    marked = stored(filled.withColumn("state", state).where("state IS NOT NULL").drop("bucket_size"))

    # The bucket in which a quota ends: one small group per source.
    ends = marked.where("state = 0").select(
        F.col("source").alias("its"), F.col("bucket").alias("its_bucket"), "below", "quota"
    )
    inside = rows.join(
        ends, F.col("source").eqNullSafe(F.col("its")) & (F.col("bucket") == F.col("its_bucket"))
    )
    line = Window.partitionBy("source").orderBy("place", "doc_id", "size", "row")
    reached = F.col("below") + F.sum("size").over(line)
    early = inside.withColumn("reached", reached).where("reached <= quota")
    early = early.select(F.col("row").alias("its_row"))
    done = marked.where("state = 1").select(
        F.col("source").alias("its"), F.col("bucket").alias("its_bucket"), F.lit(True).alias("in_full")
    )
    chosen = (
        rows.join(
            done,
            F.col("source").eqNullSafe(F.col("its")) & (F.col("bucket") == F.col("its_bucket")),
            "left",
        )
        .drop("its", "its_bucket")
        .join(early.withColumn("in_part", F.lit(True)), F.col("row") == F.col("its_row"), "left")
        .select("doc_id", "source", "size", "place", "row", F.coalesce("in_full", "in_part", F.lit(False)).alias("extra"))
    )
    rated = rated.withColumnRenamed("source", "its")
    chosen = stored(chosen.join(rated, F.col("source").eqNullSafe(F.col("its"))).drop("its"))

    # The one document per source that closes the gap best, if any does.
    taken = chosen.where("extra").groupBy("source").agg(F.sum("size").alias("extra_size"))
    taken = taken.withColumnRenamed("source", "its")
    spare = chosen.where("NOT extra AND size > 0 AND quota > 0").join(
        taken, F.col("source").eqNullSafe(F.col("its")), "left"
    )
    gap = F.col("quota") - F.coalesce("extra_size", F.lit(0))
    error = F.abs(gap - F.col("size"))
    closing = (
        spare.where(error < gap)
        .groupBy("source")
        .agg(F.min(F.struct(error.alias("error"), "place", "doc_id", "row")).alias("best"))
        .select(F.col("best.row").alias("its_row"), F.lit(True).alias("closes"))
    )
    out = chosen.join(closing, F.col("row") == F.col("its_row"), "left")
    copies = F.col("whole") + (F.col("extra") | F.coalesce("closes", F.lit(False))).cast("bigint")
    copies = F.least(copies, F.lit(most).cast("bigint"))
    return out.withColumn("copies", copies).select(
        "doc_id", "source", "size", "source_size", "weight", "target", "rate", "copies",
        (F.col("copies") * F.col("size")).alias("taken"), "place", "row",
    )


def mixed(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options
) -> DataFrame:
    """The documents as often as the mix takes them, with all their columns."""
    taken = mix(docs, id_col, text_col, source_col, **options).where("copies > 0")
    taken = stored(taken.groupBy(F.col("place").alias("_place")).agg(F.sum("copies").cast("int").alias("_n")))
    rows = docs.withColumn("_own", F.xxhash64(id_col, text_col))
    rows = rows.join(taken, F.col("_own") == F.col("_place")).dropDuplicates(["_own"])
    rows = rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns])
