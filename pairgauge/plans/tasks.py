"""Binary tasks over the star-schema tables: the datasets the registered queries work on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..frame import LabelledFrame
from ..sources.tables import read_table
from .rules import RuleInputs

# The line keys alone repeat now and then; with the price in cents they are unique.
_LINE_ID = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
RETURNS_RULES = RuleInputs("quantity", 0.0, 50.0, ("linestatus", "discount", "tax"))


def supplier_name(key: Column) -> Column:
    return F.concat(F.lit("supplier-"), key.cast("string"))


def nation_name(key: Column) -> Column:
    return F.concat(F.lit("nation-"), key.cast("string"))


def _zero_missing(name: str) -> Column:
    return F.nullif(F.col(name), F.lit(0.0))


def _named(name: str, key: str) -> Column:
    """Dataset name as a column of the rows.

    A bare literal would be folded out of join conditions and leave joins without a key.
    """
    return F.when(F.col(key).isNotNull(), name).alias("dataset")


def returns_rows(spark: SparkSession, sf: str) -> DataFrame:
    """lineitem with its supplier: one dataset per supplier, one family per nation."""
    items = read_table(spark, sf, "lineitem")
    suppliers = read_table(spark, sf, "supplier")
    return items.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey")).select(
        supplier_name(F.col("l_suppkey")).alias("dataset"),
        nation_name(F.col("s_nationkey")).alias("family"),
        F.concat_ws(
            "-",
            *[F.col(c).cast("string") for c in _LINE_ID],
            F.round(F.col("l_extendedprice") * 100).cast("bigint").cast("string"),
        ).alias("row_id"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_extendedprice").alias("price"),
        _zero_missing("l_discount").alias("discount"),
        _zero_missing("l_tax").alias("tax"),
        F.col("l_linestatus").alias("linestatus"),
        F.col("l_returnflag").alias("label"),
        (F.col("l_returnflag") == "R").cast("int").alias("y"),
    )


def returns(spark: SparkSession, sf: str) -> LabelledFrame:
    """Was a line returned? Numeric quantity, price, discount, tax; categorical line status."""
    return LabelledFrame(
        returns_rows(spark, sf), ("quantity", "price", "discount", "tax"), ("linestatus",)
    )


def returns_coarse(spark: SparkSession, sf: str) -> LabelledFrame:
    """The returns task on three coarse columns, where signatures repeat."""
    return LabelledFrame(returns_rows(spark, sf), ("quantity", "discount", "tax"), ())


def suppliers(spark: SparkSession, sf: str) -> DataFrame:
    """One row per supplier dataset with its registry identity."""
    nation = F.col("s_nationkey")
    return read_table(spark, sf, "supplier").select(
        supplier_name(F.col("s_suppkey")).alias("dataset"),
        F.col("s_suppkey").alias("key"),
        supplier_name(F.col("s_suppkey")).alias("name"),
        (F.col("s_suppkey") + 1).cast("bigint").alias("openml_id"),
        F.lit(1).cast("bigint").alias("version"),
        nation_name(nation).alias("family"),
        (nation % 5 == 0).alias("clinical"),
    )


def _document_task(spark: SparkSession, sf: str, label: str) -> LabelledFrame:
    documents = read_table(spark, sf, "documents")
    labels = read_table(spark, sf, "labels")
    rows = documents.join(labels, "doc_id").select(
        _named(f"doc_{label}", "doc_id"),
        F.lit("documents").alias("family"),
        F.col("doc_id").cast("string").alias("row_id"),
        F.col("n_chars").cast("double").alias("n_chars"),
        "lang",
        "source",
        F.col(label).cast("int").alias("y"),
    )
    return LabelledFrame(rows, ("n_chars",), ("lang", "source"))


def quality(spark: SparkSession, sf: str) -> LabelledFrame:
    return _document_task(spark, sf, "quality")


def toxic(spark: SparkSession, sf: str) -> LabelledFrame:
    return _document_task(spark, sf, "toxic")


def urgent(spark: SparkSession, sf: str) -> LabelledFrame:
    rows = read_table(spark, sf, "orders").select(
        _named("order_urgent", "o_orderkey"),
        F.lit("orders").alias("family"),
        F.col("o_orderkey").cast("string").alias("row_id"),
        F.col("o_totalprice").alias("totalprice"),
        F.col("o_orderstatus").alias("orderstatus"),
        (F.col("o_orderpriority") == "1-URGENT").cast("int").alias("y"),
    )
    return LabelledFrame(rows, ("totalprice",), ("orderstatus",))


def purchase(spark: SparkSession, sf: str) -> LabelledFrame:
    rows = read_table(spark, sf, "events").select(
        _named("event_purchase", "event_id"),
        F.lit("events").alias("family"),
        F.col("event_id").cast("string").alias("row_id"),
        "value",
        F.hour("ts").cast("string").alias("hour"),
        (F.col("event_type") == "purchase").cast("int").alias("y"),
    )
    return LabelledFrame(rows, ("value",), ("hour",))


def building(spark: SparkSession, sf: str) -> LabelledFrame:
    rows = read_table(spark, sf, "customer").select(
        _named("cust_building", "c_custkey"),
        F.lit("customer").alias("family"),
        F.col("c_custkey").cast("string").alias("row_id"),
        F.col("c_acctbal").alias("acctbal"),
        F.col("c_nationkey").cast("string").alias("nation"),
        (F.col("c_mktsegment") == "BUILDING").cast("int").alias("y"),
    )
    return LabelledFrame(rows, ("acctbal",), ("nation",))


def order_datasets(spark: SparkSession, sf: str) -> LabelledFrame:
    """One tiny dataset per order, many of them unfit for a benchmark; a zero tax is infinite."""
    rows = read_table(spark, sf, "lineitem").select(
        F.concat(F.lit("order-"), F.col("l_orderkey").cast("string")).alias("dataset"),
        F.concat_ws(
            "-", *[F.col(c).cast("string") for c in ("l_linenumber", "l_partkey", "l_suppkey")]
        ).alias("row_id"),
        F.col("l_quantity").alias("quantity"),
        F.when(F.col("l_tax") == 0, F.lit(float("inf")))
        .otherwise(F.col("l_extendedprice"))
        .alias("price"),
        F.col("l_linestatus").alias("linestatus"),
        (F.col("l_returnflag") == "R").cast("int").alias("y"),
    )
    return LabelledFrame(rows, ("quantity", "price"), ("linestatus",))
