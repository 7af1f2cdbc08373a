"""A meta-table of scores that are really measured: two small classifiers on the lines of every supplier.

Both learn from lines shipped before ``LEARN_BEFORE`` and are scored on later ones: ``vote`` gives the class
that is more frequent among learned lines of the same status than over all, ``centroid`` the class whose mean
quantity and price are nearer. Everything comes from grouped sums over all datasets at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..frame import LabelledFrame
from ..operators import profile
from ..sources.tables import read_table
from . import tasks

LEARN_BEFORE = "1997-01-01"
LABELS = ("vote", "centroid")
GAP = "gap_centroid_minus_vote"


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "lineitem").select(
        tasks.supplier_name(F.col("l_suppkey")).alias("dataset"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_extendedprice").alias("price"),
        F.col("l_linestatus").alias("linestatus"),
        (F.col("l_returnflag") == "R").cast("int").alias("y"),
        (F.col("l_shipdate") < F.lit(LEARN_BEFORE)).alias("learned"),
    )


def _balanced(hit: Column, n: Column | None = None) -> Column:
    """Mean recall over the two classes; null where a class is absent."""
    n = F.lit(1) if n is None else n
    recall = [
        F.sum(F.when(hit & (F.col("y") == c), n).otherwise(0)) / F.nullif(F.sum(F.when(F.col("y") == c, n)), F.lit(0))
        for c in (0, 1)
    ]
    return (recall[0] + recall[1]) / 2


def vote_scores(lines: DataFrame) -> DataFrame:
    """(dataset, score_vote) from counts per status and class."""
    cells = lines.groupBy("dataset", "linestatus", "learned", "y").agg(F.count(F.lit(1)).alias("n"))
    learned = cells.where("learned")
    positive = F.sum(F.col("n") * F.col("y"))
    own = learned.groupBy("dataset", "linestatus").agg(positive.alias("own_positive"), F.sum("n").alias("own"))
    whole = own.groupBy("dataset").agg(F.sum("own_positive").alias("positive"), F.sum("own").alias("all"))
    told = cells.where("NOT learned").join(whole, "dataset").join(own, ["dataset", "linestatus"], "left")
    guess = F.coalesce(F.col("own_positive") * F.col("all") > F.col("positive") * F.col("own"), F.lit(False))
    return told.groupBy("dataset").agg(_balanced(guess.cast("int") == F.col("y"), F.col("n")).alias("score_vote"))


def centroid_scores(lines: DataFrame) -> DataFrame:
    """(dataset, score_centroid) from class means and spreads, then one scan of the later lines."""
    names = ("quantity", "price")
    learned = lines.where("learned")
    facts = [F.stddev_pop(c).alias(f"{c}_s") for c in names]
    for c in names:
        facts += [F.avg(F.when(F.col("y") == k, F.col(c))).alias(f"{c}_{k}") for k in (0, 1)]
    centres = learned.groupBy("dataset").agg(*facts)
    away = [
        sum(F.pow((F.col(c) - F.col(f"{c}_{k}")) / F.nullif(F.col(f"{c}_s"), F.lit(0.0)), 2) for c in names)
        for k in (0, 1)
    ]
    told = lines.where("NOT learned").join(centres, "dataset")
    guess = F.coalesce(away[1] < away[0], F.lit(False)).cast("int")
    return told.groupBy("dataset").agg(_balanced(guess == F.col("y")).alias("score_centroid"))


def measured_meta(spark: SparkSession, sf: str) -> DataFrame:
    """Descriptors, family, region and both scores of every supplier that can be described and scored."""
    lines = _lines(spark, sf)
    described = profile.characterize(tasks.returns(spark, sf)).where("status = 'ok'").drop("status")
    nations = read_table(spark, sf, "nation").select(
        tasks.nation_name(F.col("n_nationkey")).alias("family"), F.col("n_regionkey").cast("string").alias("region")
    )
    scored = vote_scores(lines).join(centroid_scores(lines), "dataset")
    scored = scored.where("score_vote IS NOT NULL AND score_centroid IS NOT NULL")
    identity = tasks.suppliers(spark, sf).select("dataset", "family").join(nations, "family")
    gap = (F.col("score_centroid") - F.col("score_vote")).alias(GAP)
    return identity.join(described, "dataset").join(scored, "dataset").select("*", gap)


def buyer_rows(spark: SparkSession, sf: str) -> LabelledFrame:
    """The returns task by the nation of the buyer: tables that have descriptors but no scores."""
    lines = read_table(spark, sf, "lineitem")
    orders = read_table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    customers = read_table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    nations = read_table(spark, sf, "nation")
    joined = (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    )
    zero = lambda c: F.nullif(F.col(c), F.lit(0.0))
    rows = joined.select(
        F.concat(F.lit("buyer-"), F.col("c_nationkey").cast("string")).alias("dataset"),
        F.col("n_regionkey").cast("string").alias("region"),
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(F.col("l_extendedprice") * 100).cast("bigint")).alias("row_id"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_extendedprice").alias("price"),
        zero("l_discount").alias("discount"),
        zero("l_tax").alias("tax"),
        F.col("l_linestatus").alias("linestatus"),
        (F.col("l_returnflag") == "R").cast("int").alias("y"),
    )
    return LabelledFrame(rows, ("quantity", "price", "discount", "tax"), ("linestatus",), ("dataset", "region"))


def new_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Descriptors of the buyers' tables."""
    return profile.characterize(buyer_rows(spark, sf)).where("status = 'ok'").drop("status")
