"""Seeded stratified hold-outs and folds for every dataset in one job.

Inside (dataset, class), rows are ordered by an md5 of seed and row id: no random state, the same
answer for any partitioning, and reproducible in SQL. The order is cut into consecutive blocks:
the hold-out, then the inner folds. A row's block follows from comparing its token with the few
tokens at the block ends, so the rows themselves are never shuffled or sorted.

The block ends are exact order statistics. A class of bounded size is ordered as one list: its row
ids are exchanged once for all seeds. md5 is uniform, so leading digits cut a larger class into equal
buckets; a histogram of buckets shows where the ends lie and only those buckets are ranked. A class
holding a third of all rows therefore never sits in one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..frame import LabelledFrame
from ..session import stored

# A class is cut into buckets of about this many rows; only those that hold a block end are ordered.
ROWS_PER_BUCKET = 256
# A class of at most this many buckets is one list; most of its buckets would hold a block end anyway.
LISTED_BUCKETS = 16
_BUCKET_DIGITS = 4


def row_id_status(lf: LabelledFrame) -> DataFrame:
    """(keys, n_rows, n_ids, repeated_rows, status): whether ids are present and unique in each dataset."""
    rows = F.col("__rows")
    counted = lf.df.groupBy(*lf.keys, lf.row_id).agg(F.count(F.lit(1)).alias("__rows"))
    missing = F.count_if(F.col(lf.row_id).isNull())
    repeated = F.coalesce(F.sum(F.when(rows > 1, rows)), F.lit(0).cast("long"))
    return counted.groupBy(*lf.keys).agg(
        F.sum(rows).alias("n_rows"),
        F.count(F.lit(1)).alias("n_ids"),
        repeated.alias("repeated_rows"),
        F.when(missing > 0, "missing_row_id").when(repeated > 0, "repeated_row_id").otherwise("ok").alias("status"),
    )


def class_quotas(lf: LabelledFrame, test_size: float) -> DataFrame:
    """Hold-out size per class: ceil(test_size * n) rows by largest remainder, low class first."""
    sizes = lf.df.groupBy(*lf.keys, lf.target).agg(F.count(F.lit(1)).alias("class_rows"))
    whole = Window.partitionBy(*lf.keys)
    by_rest = whole.orderBy(F.col("rest").desc(), F.col(lf.target))
    lower = whole.orderBy(lf.target).rowsBetween(Window.unboundedPreceding, -1)
    total, per_class = F.col("total_rows"), F.col("class_rows")
    return (
        sizes.withColumn("total_rows", F.sum("class_rows").over(whole))
        .withColumn("test_total", F.ceil(total * F.lit(test_size)))
        .withColumn("base", F.expr("(test_total * class_rows) div total_rows"))
        .withColumn("rest", (F.col("test_total") * per_class) % total)
        .withColumn("left_over", F.col("test_total") - F.sum("base").over(whole))
        .withColumn(
            "class_test",
            F.col("base")
            + (F.row_number().over(by_rest) <= F.col("left_over")).cast("long"),
        )
        .withColumn("class_train", per_class - F.col("class_test"))
        .withColumn("train_before", F.coalesce(F.sum("class_train").over(lower), F.lit(0)))
        .select(
            *lf.keys, lf.target, "class_rows", "total_rows", "test_total", "class_test",
            "class_train", "train_before",
        )
    )


def seed_token(seed: Column, row_id: Column) -> Column:
    return F.md5(F.concat_ws("|", seed.cast("string"), row_id.cast("string")))


def _bucket(token: Column, class_rows: Column, rows_per_bucket: int) -> Column:
    """Order-preserving bucket of a uniform hex token, sized by the class."""
    leading = F.conv(F.substring(token, 1, _BUCKET_DIGITS), 16, 10).cast("long")
    span = 16**_BUCKET_DIGITS
    buckets = F.least(F.ceil(class_rows / F.lit(rows_per_bucket)), F.lit(span))
    return F.floor(leading * buckets / F.lit(span))


def _block_ends(inner_folds: int) -> Column:
    """Last rank of the hold-out and of each fold but the last one, for one class.

    Train row j of a class is number ``train_before + j`` of its dataset and counts for fold
    (number modulo k): fold i gets ``n // k + (i < n % k)`` rows over all classes, and every
    class is spread evenly.
    """
    ends, last = [F.col("class_test")], F.col("class_test")
    for fold in range(inner_folds - 1):
        first = F.pmod(F.lit(fold) - F.col("train_before"), F.lit(inner_folds))
        size = F.floor((F.col("class_train") - first + inner_folds - 1) / F.lit(inner_folds))
        last = last + F.greatest(size, F.lit(0).cast("long"))
        ends.append(last)
    return F.array(*ends)


def ends_column(seed: int) -> str:
    return f"ends_{seed}"


def block_column(seed: int) -> str:
    return f"block_{seed}"


def block_cutoffs(
    lf: LabelledFrame,
    seeds: Sequence[int],
    test_size: float,
    inner_folds: int,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """(keys, target, total_rows, test_total, ends_<seed>..): tokens at the block ends of a class.

    ``ends_<seed>`` has ``inner_folds`` tokens: the last of the hold-out and of each fold but the
    last; an empty leading block ends at ''. The class sizes are stored first, since every step
    below needs them and they are one row per class.
    """
    by_class = [*lf.keys, lf.target]
    quotas = stored(
        class_quotas(lf, test_size).select(
            *by_class, "class_rows", "total_rows", "test_total",
            _block_ends(inner_folds).alias("ranks"),
        )
    )
    large = stored(
        quotas.where(F.col("class_rows") > LISTED_BUCKETS * rows_per_bucket).select(*by_class, "class_rows")
    )
    listed = _ends_of_lists(lf, quotas, large, seeds, inner_folds)
    bucketed = _ends_of_buckets(lf, quotas, large, seeds, inner_folds, rows_per_bucket)
    return listed.unionByName(bucketed)


def _ends_of_lists(
    lf: LabelledFrame, quotas: DataFrame, large: DataFrame, seeds: Sequence[int], inner_folds: int
) -> DataFrame:
    """Block ends of the classes that aren't ``large``, each from the list of its row ids.

    The class sizes come as one more row of each class, so the lists need no join.
    """
    by_class = [*lf.keys, lf.target]
    facts = ["total_rows", "test_total", "ranks"]
    none = [F.lit(None).cast(quotas.schema[c].dataType).alias(c) for c in facts]
    # A missing id has a token too, and lists leave out nulls.
    member = F.struct(F.col(lf.row_id).alias("id")).alias("member")
    rows = lf.df.join(large, by_class, "left_anti").select(*by_class, member, *none)
    sizes = quotas.join(large, by_class, "left_anti").select(
        *by_class, F.lit(None).cast(rows.schema["member"].dataType).alias("member"), *facts
    )
    lists = (
        rows.union(sizes)
        .repartition(*by_class)
        .groupBy(*by_class)
        .agg(F.collect_list("member").alias("members"), *[F.max(c).alias(c) for c in facts])
        .where(reduce(and_, [F.col(c).isNotNull() for c in by_class]))
    )

    def tokens(seed: int) -> Column:
        # No token is missing, and unlike array_sort this needs no comparator.
        return F.sort_array(F.transform("members", lambda m: seed_token(F.lit(seed), m["id"])))

    ordered = {f"tokens_{s}": tokens(s) for s in seeds}

    def token(seed: int, rank: Column) -> Column:
        return F.when(rank > 0, F.get(f"tokens_{seed}", rank.cast("int") - 1)).otherwise("")

    ends = {s: [token(s, F.col("ranks")[i]) for i in range(inner_folds)] for s in seeds}
    return lists.select(*by_class, *facts, *[v.alias(k) for k, v in ordered.items()]).select(
        *by_class, "total_rows", "test_total", *[F.array(*ends[s]).alias(ends_column(s)) for s in seeds]
    )


def _ends_of_buckets(
    lf: LabelledFrame,
    quotas: DataFrame,
    large: DataFrame,
    seeds: Sequence[int],
    inner_folds: int,
    rows_per_bucket: int,
) -> DataFrame:
    """Block ends of the ``large`` classes, of which only the buckets with an end are ordered."""
    by_class = [*lf.keys, lf.target]
    quotas = quotas.join(large.select(*by_class), by_class, "left_semi")
    tokens = (
        lf.df.select(*by_class, lf.row_id)
        .join(large, by_class)
        .withColumn("outer_seed", F.explode(F.array(*[F.lit(s) for s in seeds])))
        .withColumn("token", seed_token(F.col("outer_seed"), F.col(lf.row_id)))
        .select(
            *by_class,
            "outer_seed",
            "token",
            _bucket(F.col("token"), F.col("class_rows"), rows_per_bucket).alias("bucket"),
        )
    )
    in_bucket = [*by_class, "outer_seed", "bucket"]
    tokens = _near_block_ends(tokens, quotas, by_class)
    inside = Window.partitionBy(*in_bucket).orderBy("token")
    wanted = [f"rank_{i}" for i in range(inner_folds)]
    ends = quotas.select(*by_class, *[F.col("ranks")[i].alias(r) for i, r in enumerate(wanted)])
    ranked = (
        tokens.withColumn("rank", F.col("bucket_start") + F.row_number().over(inside))
        .join(ends, by_class)
        .filter(F.col("rank").isin(*[F.col(r) for r in wanted]))
        .groupBy(*by_class)
        .agg(
            *[
                F.collect_list(
                    F.when(F.col("outer_seed") == s, F.struct("rank", "token"))
                ).alias(f"found_{s}")
                for s in seeds
            ]
        )
    )
    # A class can have all its ends at rank 0 and so no ranked row at all.
    return quotas.join(ranked, by_class, "left").select(
        *by_class,
        "total_rows",
        "test_total",
        *[_token_at_ranks(F.col(f"found_{s}")).alias(ends_column(s)) for s in seeds],
    )


def _near_block_ends(tokens: DataFrame, quotas: DataFrame, by_class: list[str]) -> DataFrame:
    """Tokens of the buckets that hold a block end, with the number of rows in earlier buckets."""
    in_bucket = [*by_class, "outer_seed", "bucket"]
    earlier = (
        Window.partitionBy(*by_class, "outer_seed")
        .orderBy("bucket")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    holds_end = F.exists(
        "ranks",
        lambda r: (r > F.col("bucket_start")) & (r <= F.col("bucket_start") + F.col("n")),
    )
    kept = (
        tokens.groupBy(*in_bucket)
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("bucket_start", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
        .join(quotas.select(*by_class, "ranks"), by_class)
        .filter(holds_end)
        .select(*in_bucket, "bucket_start")
    )
    return tokens.join(kept, in_bucket)


def _token_at_ranks(found: Column) -> Column:
    """Token of each wanted rank out of a handful of (rank, token) pairs."""
    return F.transform(
        "ranks",
        lambda r: F.coalesce(
            F.try_element_at(F.filter(found, lambda f: f["rank"] == r), F.lit(1))["token"],
            F.lit(""),
        ),
    )


def assign_blocks(
    lf: LabelledFrame,
    cutoffs: DataFrame,
    seeds: Sequence[int],
    inner_folds: int,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Every row once, with a column ``block_<seed>`` per seed: 0 for test, fold + 1 for train.

    The rows only meet the small cutoff table; they are neither ranked nor exchanged. Datasets
    without cutoffs drop out.
    """
    by_class = [*lf.keys, lf.target]
    ends = [ends_column(s) for s in seeds]

    def block(seed: int) -> Column:
        token = F.col(f"token_{seed}")
        return sum(
            ((token > F.col(ends_column(seed))[i]).cast("int") for i in range(inner_folds)),
            F.lit(0),
        )

    return (
        lf.df.select(*by_class, lf.row_id, *carry)
        .join(cutoffs.select(*by_class, *ends), by_class)
        .withColumns({f"token_{s}": seed_token(F.lit(s), F.col(lf.row_id)) for s in seeds})
        .select(
            *by_class, lf.row_id, *carry, *[block(s).alias(block_column(s)) for s in seeds]
        )
    )


def assign_with(
    lf: LabelledFrame,
    cutoffs: DataFrame,
    seeds: Sequence[int],
    inner_folds: int,
    carry: Sequence[str] = (),
) -> DataFrame:
    """``assign_splits`` from cutoffs computed before."""
    return per_seed(lf, assign_blocks(lf, cutoffs, seeds, inner_folds, carry), seeds, carry)


def per_seed(
    lf: LabelledFrame, blocks: DataFrame, seeds: Sequence[int], carry: Sequence[str] = ()
) -> DataFrame:
    """The rows of ``assign_blocks`` once per seed, with part and fold; their ids may have been dropped."""
    named = [lf.row_id] if lf.row_id in blocks.columns else []
    entries = F.array(
        *[
            F.struct(F.lit(s).alias("outer_seed"), F.col(block_column(s)).alias("block"))
            for s in seeds
        ]
    )
    block = F.col("split.block")
    return (
        blocks.withColumn("split", F.explode(entries))
        .select(
            *lf.keys,
            "split.outer_seed",
            *named,
            lf.target,
            *carry,
            F.when(block == 0, "test").otherwise("train").alias("part"),
            F.when(block > 0, block - 1).alias("fold"),
        )
    )


def assign_splits(
    lf: LabelledFrame,
    seeds: Sequence[int],
    test_size: float,
    inner_folds: int,
    carry: Sequence[str] = (),
    rows_per_bucket: int = ROWS_PER_BUCKET,
    unique_ids: bool = False,
) -> DataFrame:
    """Every row once per seed with ``part`` ('train'/'test') and its inner ``fold``.

    Test rows have a NULL fold. Both pipelines read this one table, hence identical partitions. With
    ``unique_ids``, datasets whose row ids are missing or repeat (see ``row_id_status``) are left out, so
    that all sizes hold exactly.
    """
    if unique_ids:
        good = stored(row_id_status(lf).where("status = 'ok'").select(*lf.keys))
        lf = lf.with_df(lf.df.join(good, list(lf.keys), "left_semi"))
    cutoffs = stored(block_cutoffs(lf, seeds, test_size, inner_folds, rows_per_bucket))
    return assign_with(lf, cutoffs, seeds, inner_folds, carry)


def fold_sizes(assigned: DataFrame, keys: Sequence[str], inner_folds: int) -> DataFrame:
    """Observed against expected rows of every inner fold."""
    counted = (
        assigned.filter("part = 'train'")
        .groupBy(*keys, "outer_seed", "fold")
        .agg(F.count(F.lit(1)).alias("fold_rows"))
    )
    total = F.sum("fold_rows").over(Window.partitionBy(*keys, "outer_seed"))
    extra = (F.col("fold") < F.col("train_rows") % inner_folds).cast("long")
    return counted.withColumn("train_rows", total).withColumn(
        "expected_rows", F.expr(f"train_rows div {inner_folds}") + extra
    )
