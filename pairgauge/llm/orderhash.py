"""Order MinHash fingerprints of documents, sensitive to edit distance; built-in functions only.

A text's k-mers are runs of ``K`` words. Equal k-mers are numbered by occurrence, so a repeat is an item of
its own. Under each of ``HASHES`` orders one item is minimal; the value of an order holds the item's hash
in its high bits and its place in the low ones, and a plain minimum finds both. A tuple joins the minimal
items of ``TUPLE`` orders in the order in which they stand in the text and is hashed to 16 bits. Equal
tuples need equal items in equal order, which edits and moves of text break.

Items are numbered inside each row: sorted packed hashes put equal k-mers side by side. Only the items
are exploded, and they meet again in the task they come from, so no item is shuffled.

The next document in descending order of ids is found without a global sort: ids fall into ranges, the
first document of each range is also laid behind the range before it, and a window looks one row ahead.
Each text is shuffled once.

Defined cases: a null text is empty; a text of fewer than ``K`` words is one k-mer; all texts without words
have the same fingerprint; null ids come last, by a hash of their text; rows with one id follow each
other in table order; the only document is its own next one; places beyond 2**26 words count modulo it;
other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import picked, stored

K = 3
HASHES = 64
TUPLE = 2
PLACE_BITS = 26
RANGE_DOCUMENTS = 250
MOST_RANGES = 1 << 16

_PLACE = (1 << PLACE_BITS) - 1
_NULLS = -(1 << 62)


def _high(value: Column) -> Column:
    return F.shiftright(value, PLACE_BITS)


def _with_place(value: Column, place: Column) -> Column:
    return value.bitwiseAND(F.lit(~_PLACE)).bitwiseOR(place.bitwiseAND(F.lit(_PLACE)))


def items(rows: DataFrame, text: str, k: int = K) -> DataFrame:
    """Adds ``items``: occurrence-numbered k-mers, each a hash with its place in the low bits.

    Every step is a column of its own, so that no array is computed once for each of its elements.
    """
    kept = [c for c in rows.columns if c != text]
    rows = rows.withColumn("_words", F.array_remove(F.split(F.col(text), r"[ \t-\r]+"), ""))
    rows = rows.select(*kept, F.transform("_words", lambda w: F.xxhash64(w)).alias("_w"))
    run = F.slice("_w", F.lit(1), F.greatest(F.size("_w") - F.lit(k - 1), F.lit(0)))
    several = F.transform(
        run,
        lambda first, i: _with_place(
            F.xxhash64(first, *[F.get("_w", i + F.lit(j)) for j in range(1, k)]), i.cast("bigint")
        ),
    )
    whole = F.when(F.size("_w") > 0, F.array(_with_place(F.xxhash64("_w"), F.lit(0).cast("bigint"))))
    none = F.array().cast("array<bigint>")
    packed = F.when(F.size("_w") >= k, several).otherwise(F.coalesce(whole, none))
    rows = rows.select(*kept, F.sort_array(packed).alias("_p"))
    same = lambda i: _high(F.get("_p", i)) == _high(F.get("_p", i - 1))
    firsts = F.filter(
        F.sequence(F.lit(0), F.size("_p") - 1), lambda i: (i == 0) | ~same(i)
    )
    rows = rows.select(*kept, "_p", F.when(F.size("_p") > 0, firsts).alias("_s"))

    def numbered(value: Column, number: Column) -> Column:
        return _with_place(F.xxhash64(_high(value), number), value)

    alone = F.transform("_p", lambda p: numbered(p, F.lit(0)))
    groups = F.transform(
        "_s",
        lambda s, g: F.transform(
            F.slice("_p", s + 1, F.coalesce(F.get("_s", g + 1), F.size("_p")) - s),
            lambda p, o: numbered(p, o),
        ),
    )
    made = F.when(F.size("_s") == F.size("_p"), alone).otherwise(F.flatten(groups))
    return rows.select(*kept, F.coalesce(made, none).alias("items"))


def minima(item: Column, hashes: int = HASHES) -> list[Column]:
    """The least value of every order; null without items."""
    return [
        F.min(_with_place(F.xxhash64(_high(item), F.lit(j)), item)).alias(f"m{j}") for j in range(hashes)
    ]


def tuples(hashes: int = HASHES, length: int = TUPLE) -> Column:
    """Fingerprint text: four hex digits for each tuple of minimal items in text order."""
    parts = []
    for j in range(hashes):
        chosen = [F.col(f"m{(j + step) % hashes}") for step in range(length)]
        ordered = F.sort_array(
            F.array(*[F.struct(m.bitwiseAND(F.lit(_PLACE)).alias("at"), _high(m).alias("item")) for m in chosen])
        )
        value = F.xxhash64(F.transform(ordered, lambda m: m["item"]), F.lit(j)).bitwiseAND(F.lit(0xFFFF))
        parts.append(F.lpad(F.lower(F.hex(value)), 4, "0"))
    return F.concat(*parts)


def likeness(a: Column, b: Column, hashes: int = HASHES, length: int = TUPLE) -> Column:
    """Estimated share of text that two fingerprints have in common, in equal order: 0 to 1.

    A share p of equal tuples of n orders means a Jaccard likeness j near the n-th root of p; of two
    texts of like size 2j / (1 + j) is the share of k-mers they have in common.
    """
    equal = F.aggregate(
        F.sequence(F.lit(0), F.lit(hashes - 1)),
        F.lit(0),
        lambda n, j: n + (F.substring(a, 4 * j + 1, F.lit(4)) == F.substring(b, 4 * j + 1, F.lit(4))).cast("int"),
    )
    j = F.pow(equal / F.lit(float(hashes)), F.lit(1.0 / length))
    return F.when(a == b, F.lit(1.0)).otherwise(2 * j / (1 + j))


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, row, text, bucket and the text and row of the next document, descending ids."""
    rows = picked(docs, doc_id=id_col, text=text_col)
    text = F.coalesce("text", F.lit(""))
    nameless = F.lit(_NULLS) - F.shiftrightunsigned(F.xxhash64("text"), 2)
    order = F.coalesce(F.col("doc_id").cast("bigint"), nameless)
    rows = rows.select("doc_id", text.alias("text"), order.alias("place"))
    row = F.monotonically_increasing_id()
    found = rows.where("doc_id IS NOT NULL").agg(F.count("*"), F.min("place"), F.max("place")).first()
    count, low, high = found[0], found[1] or 0, found[2] or 0
    ranges = max(1, min(MOST_RANGES, -(-count // RANGE_DOCUMENTS)))
    width = (high - low) // ranges + 1
    named = F.floor((F.lit(high) - F.col("place")) / F.lit(width)).cast("int")
    # The hash of a nameless row's text has 62 bits; its top ones choose among as many ranges again.
    other = F.floor((F.lit(_NULLS) - F.col("place")) / F.lit(float(1 << 62)) * F.lit(ranges)).cast("int")
    bucket = F.when(F.col("doc_id").isNull(), F.least(other, F.lit(ranges - 1)) + ranges).otherwise(named)
    rows = rows.withColumn("bucket", bucket)
    # One row per range, at most 2 * MOST_RANGES of them.
    heads = rows.groupBy("bucket").agg(F.max("place").alias("place")).orderBy("bucket").collect()
    tails = [(heads[k]["place"], heads[k]["bucket"], heads[k - 1]["bucket"]) for k in range(len(heads))]
    behind = rows.sparkSession.createDataFrame(tails, "head bigint, its_bucket int, before int")
    joined = rows.withColumn("row", row).join(
        F.broadcast(behind),
        (F.col("place") == F.col("head")) & (F.col("bucket") == F.col("its_bucket")),
        "left",
    )
    spots = F.array_compact(
        F.array(
            F.struct(F.col("bucket"), F.lit(False).alias("tail")),
            F.when(F.col("before").isNotNull(), F.struct(F.col("before").alias("bucket"), F.lit(True).alias("tail"))),
        )
    )
    laid = joined.select("doc_id", "place", "row", "text", F.explode(spots).alias("spot"))
    laid = laid.select("doc_id", "place", "row", "text", "spot.bucket", "spot.tail")
    line = Window.partitionBy("bucket").orderBy("tail", F.col("place").desc(), "row")
    laid = laid.withColumn("next_text", F.lead("text").over(line))
    laid = laid.withColumn("next_row", F.lead("row").over(line))
    return laid.where("NOT tail").drop("tail", "place")


def _digits(sha: Column) -> list[Column]:
    """A SHA-256 in hex as four numbers, which an aggregation can carry without sorting."""
    return [
        F.conv(F.substring(sha, 16 * k + 1, 16), 16, 10).cast("decimal(20,0)").alias(f"sha{k}")
        for k in range(4)
    ]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each document and of its text with the second half from the next document.

    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    """
    rows = with_next(docs, id_col, text_col)
    half = F.floor(F.length("text") / 2).cast("int")
    rows = rows.withColumn("half", half).withColumn(
        "edited",
        F.concat(
            F.expr("substring(text, 1, length(text) - half)"), F.expr("substring(next_text, 1, half)")
        ),
    )
    meta = ["doc_id", "next_row", "n_chars", "sha0", "sha1", "sha2", "sha3"]
    rows = rows.select(
        "bucket", "row", "doc_id", "next_row", F.length("text").cast("bigint").alias("n_chars"),
        *_digits(F.sha2("edited", 256)), F.posexplode(F.array("text", "edited")).alias("kind", "body"),
    )
    made = items(rows, "body")
    exploded = made.select("bucket", "row", "kind", *meta, F.explode_outer("items").alias("item"))
    least = exploded.groupBy("bucket", "row", "kind").agg(
        *[F.any_value(c).alias(c) for c in meta], *minima(F.col("item"))
    )
    named = least.select("bucket", "row", "kind", *meta, tuples().alias("print"))
    pairs = named.groupBy("bucket", "row").agg(
        *[F.any_value(c).alias(c) for c in meta],
        F.max(F.when(F.col("kind") == 0, F.col("print"))).alias("fingerprint"),
        F.max(F.when(F.col("kind") == 1, F.col("print"))).alias("edited_fingerprint"),
    )
    done = stored(pairs.drop("bucket"))
    after = done.select(F.col("row").alias("r"), F.col("fingerprint").alias("next_print"))
    sha = F.concat(*[F.lpad(F.lower(F.conv(F.col(f"sha{k}").cast("string"), 10, 16)), 16, "0") for k in range(4)])
    return done.join(after, F.col("next_row") == F.col("r")).select(
        "doc_id",
        "n_chars",
        sha.alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_print")).alias("near_next"),
    )
