"""The dataset registry and the contract checks between it and what was loaded."""

from __future__ import annotations

import tomllib
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

REGISTRY_SCHEMA = """
    name string, openml_id bigint, version bigint, md5_checksum string, source_url string,
    original_source_url string, license string, family string, clinical boolean, target string,
    positive_class string, class_labels array<string>, expected_rows bigint,
    numeric_features array<string>, categorical_features array<string>,
    excluded_features array<string>, split_strategy string, split_notes string,
    selection_reason string
"""
FIELDS = tuple(part.split()[0] for part in REGISTRY_SCHEMA.split(",") if part.strip())
SUPPORTED_VERSION = 1


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """Registry entries of a TOML file, one row each.

    The file is a hand-kept catalogue, parsed on the driver; version 1, at least one entry,
    and exactly the known fields.
    """
    with Path(path).open("rb") as stream:
        payload = tomllib.load(stream)
    if payload.get("schema_version") != SUPPORTED_VERSION:
        raise ValueError("Unsupported dataset registry schema version.")
    entries = payload.get("datasets")
    if not isinstance(entries, list) or not entries:
        raise ValueError("Dataset registry is empty or missing its datasets list.")
    for entry in entries:
        if set(entry) != set(FIELDS):
            wrong = sorted(set(entry) ^ set(FIELDS))
            raise ValueError(f"Invalid dataset registry entry: unknown or missing {wrong}")
        if type(entry["clinical"]) is not bool:
            raise ValueError(f"{entry['name']}: clinical must be a boolean.")
    registry = spark.createDataFrame(entries, REGISTRY_SCHEMA)
    wrong = with_duplicates(registry).withColumn("problem", entry_problem()).filter(
        "problem IS NOT NULL"
    )
    first = wrong.orderBy("name").select("name", "problem").first()
    if first is not None:
        raise ValueError(f"{first['name']}: {first['problem']}")
    return registry


def listing(registry: DataFrame) -> DataFrame:
    """Short form: six fields per entry."""
    return registry.select(
        "name",
        "openml_id",
        "version",
        "family",
        "clinical",
        "expected_rows",
        (F.size("numeric_features") + F.size("categorical_features")).alias("n_features"),
    )


def with_duplicates(registry: DataFrame) -> DataFrame:
    """Adds ``duplicate``: the entry shares its name or its source id with another one."""
    names = registry.groupBy("name").agg(F.count(F.lit(1)).alias("name_uses"))
    ids = registry.groupBy("openml_id").agg(F.count(F.lit(1)).alias("id_uses"))
    return (
        registry.join(names, "name")
        .join(ids, "openml_id")
        .withColumn("duplicate", (F.col("name_uses") > 1) | (F.col("id_uses") > 1))
        .drop("name_uses", "id_uses")
    )


def entry_problem() -> Column:
    """First thing wrong with an entry taken by itself, else NULL."""
    labels = F.col("class_labels")
    roles = F.concat("numeric_features", "categorical_features", "excluded_features")
    two_classes = (F.size(labels) == 2) & (F.size(F.array_distinct(labels)) == 2)
    overlap = (F.size(F.array_distinct(roles)) != F.size(roles)) | F.array_contains(
        roles, F.col("target")
    )
    return (
        F.when(F.col("duplicate"), "duplicate_entry")
        .when(~two_classes | ~F.array_contains(labels, F.col("positive_class")), "class_labels")
        .when(
            F.size("numeric_features") + F.size("categorical_features") == 0, "no_predictors"
        )
        .when(overlap, "roles_overlap")
        .when(F.col("split_strategy") != "stratified", "split_strategy")
    )


def observed_labels(rows: DataFrame, registry: DataFrame, label: str) -> DataFrame:
    """(name, observed_rows, missing_targets, known_labels, unknown_labels) of loaded rows.

    ``rows`` has ``name`` and the raw label; labels are counted first, so no label set is
    collected.
    """
    counted = rows.groupBy("name", label).agg(F.count(F.lit(1)).alias("n"))
    text = F.col(label).cast("string")
    known = F.array_contains("class_labels", text)
    return (
        counted.join(registry.select("name", "class_labels"), "name")
        .groupBy("name")
        .agg(
            F.sum("n").alias("observed_rows"),
            F.coalesce(F.sum(F.when(text.isNull(), F.col("n"))), F.lit(0)).alias(
                "missing_targets"
            ),
            F.count_if(known).alias("known_labels"),
            F.count_if(~known).alias("unknown_labels"),
        )
    )


def contract_status(
    registry: DataFrame,
    manifest: DataFrame,
    labels: DataFrame,
    columns: Sequence[str],
    numeric: Sequence[str],
    target: str,
) -> DataFrame:
    """(name, status): first contract each entry breaks; 'skipped' for clinical, else 'ok'.

    ``manifest`` has name plus the landed id, version and checksum (suffix ``_found``);
    ``columns`` and ``numeric`` come from the schema of the landed table, known at plan time.
    """
    registered = F.concat("numeric_features", "categorical_features", "excluded_features")

    def same_set(left: Column, right: Column) -> Column:
        return F.array_sort(left) == F.array_sort(right)

    found = F.array(*[F.lit(c) for c in columns])
    found_numeric = F.array_except(
        F.array(*[F.lit(c) for c in numeric]).cast("array<string>"), F.col("excluded_features")
    )
    drift = (
        ~F.col("openml_id").eqNullSafe(F.col("openml_id_found"))
        | ~F.col("version").eqNullSafe(F.col("version_found"))
        | ~F.col("md5_checksum").eqNullSafe(F.col("md5_checksum_found"))
    )
    status = (
        F.when(entry_problem().isNotNull(), entry_problem())
        .when(F.col("clinical"), "skipped")
        .when(drift, "identity_mismatch")
        .when(F.col("target") != target, "target_name")
        .when(~F.col("observed_rows").eqNullSafe(F.col("expected_rows")), "row_count")
        .when(~same_set(registered, found), "columns")
        .when(~same_set(F.col("numeric_features"), found_numeric), "numeric_types")
        .when(F.col("missing_targets") > 0, "missing_target")
        .when((F.col("known_labels") != 2) | (F.col("unknown_labels") > 0), "classes")
        .otherwise("ok")
    )
    return (
        with_duplicates(registry)
        .join(manifest, "name", "left")
        .join(labels, "name", "left")
        .select("name", status.alias("status"))
    )


def select_requested(registry: DataFrame, requested: DataFrame) -> DataFrame:
    """(name, request): 'known', 'clinical' or 'unknown' for each requested name."""
    mine = registry.select("name", "clinical")
    return requested.join(mine, "name", "left").select(
        "name",
        F.when(F.col("clinical").isNull(), "unknown")
        .when(F.col("clinical"), "clinical")
        .otherwise("known")
        .alias("request"),
    )


def all_general(registry: DataFrame) -> DataFrame:
    """Entries meant by 'all': everything not clinical."""
    return registry.filter(~F.col("clinical"))
