"""Reading run artifacts as strictly parsed JSON."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed patterns of the JSON grammar: string literals and numbers.
_STRING_LITERAL = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
_NUMBER = r"-?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?"
# Only a positive exponent or some 300 digits can leave the range of a double.
_MAY_OVERFLOW = r"[eE]\+?[0-9]|[0-9]{300}"


def read_directory(spark: SparkSession, directory: str, pattern: str = "*.json") -> DataFrame:
    """(path, occurrence, content) of every matching file below a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(directory)
    return files.select("path", F.lit(0).alias("occurrence"), "content")


def read_paths(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(path, occurrence, content) of a list of files, in path order.

    A path given twice gives two rows; a path that does not exist has NULL content.
    """
    seen: Counter = Counter()
    listed = []
    for path in sorted(str(p) for p in paths):
        listed.append((path, seen[path]))
        seen[path] += 1
    inputs = spark.createDataFrame(listed, "path string, occurrence int")
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    to_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    present = [p for p in seen if to_path(p).getFileSystem(conf).exists(to_path(p))]
    if not present:
        return inputs.withColumn("content", F.lit(None).cast("binary"))
    names = spark.createDataFrame(
        [(p, to_path(p).getFileSystem(conf).makeQualified(to_path(p)).toString()) for p in present],
        "path string, uri string",
    )
    files = spark.read.format("binaryFile").load(present).select(
        F.col("path").alias("uri"), "content"
    )
    return inputs.join(names, "path", "left").join(files, "uri", "left").select(
        "path", "occurrence", "content"
    )


def from_text(rows: DataFrame, path: Column, text: Column) -> DataFrame:
    """(path, occurrence, content) from a table that already holds artifact texts."""
    return rows.select(
        path.alias("path"), F.lit(0).alias("occurrence"), text.cast("binary").alias("content")
    )


def has_overflow(text: Column) -> Column:
    """Whether a non-integer number outside of string literals exceeds the double range."""
    bare = F.regexp_replace(text, F.lit(_STRING_LITERAL), F.lit('""'))
    tokens = F.regexp_extract_all(bare, F.lit(_NUMBER), F.lit(0))
    huge = F.exists(
        tokens,
        lambda t: t.rlike("[.eE]") & (F.abs(t.try_cast("double")) == F.lit(float("inf"))),
    )
    return F.when(bare.rlike(_MAY_OVERFLOW), huge).otherwise(F.lit(False))


def strict_json(text: Column) -> Column:
    """VARIANT of a whole JSON text, or NULL if it is not strictly valid.

    The parser refuses repeated keys and NaN/Infinity tokens but stops after the first value.
    Wrapping the text in an array that must end in its own digest exposes trailing content.
    """
    mark = F.md5(text)
    wrapped = F.try_parse_json(F.concat(F.lit("["), text, F.lit(',"'), mark, F.lit('"]')))
    items = F.try_variant_get(wrapped, "$", "array<variant>")
    whole = (F.size(items) == 2) & (
        F.try_variant_get(F.try_element_at(items, F.lit(2)), "$", "string") == mark
    )
    return F.when(whole & ~has_overflow(text), F.try_element_at(items, F.lit(1)))


def parse(artifacts: DataFrame) -> DataFrame:
    """Adds ``code`` (NULL, 'unreadable_input' or 'malformed_json') and the parsed ``doc``."""
    readable = F.col("content").isNotNull() & F.is_valid_utf8(F.col("content").cast("string"))
    text = F.when(readable, F.col("content").cast("string"))
    return (
        artifacts.withColumn("doc", strict_json(text))
        .withColumn(
            "code",
            F.when(~readable, "unreadable_input").when(F.col("doc").isNull(), "malformed_json"),
        )
        .drop("content")
    )
