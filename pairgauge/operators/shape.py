"""Descriptors of the shape of columns: cardinality, skew and tails, correlation; and sampled descriptors.

Each dataset is one output row. Where no column is of the kind or has enough values, the value is null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..frame import LabelledFrame

MANY_LEVELS = 20
STRONG = 0.95
BLOCK = 128
#: Accumulated blocks of a task are passed on beyond this many.
HELD_BLOCKS = 64


def cardinalities(lf: LabelledFrame) -> DataFrame:
    """(keys, column, n_levels): distinct present values of each categorical column, exact, one scan.

    Cells are counted before they are distinct, so a frequent value travels once per task.
    """
    entries = [F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("level")) for c in lf.categorical]
    # A table without such a column has one entry that no column owns.
    nothing = F.struct(F.lit(None).cast("string").alias("column"), F.lit(None).cast("string").alias("level"))
    cells = F.explode(F.array(*(entries or [nothing])))
    long = lf.df.select(*lf.keys, cells.alias("e")).select(*lf.keys, "e.*")
    counted = long.groupBy(*lf.keys, "column", "level").agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy(*lf.keys, "column").agg(F.count("level").alias("n_levels"))


def cardinality_summary(lf: LabelledFrame, many: int = MANY_LEVELS) -> DataFrame:
    """Mean and largest number of levels, and the share of columns with more than ``many``."""
    levels = F.when(F.col("column").isNotNull(), F.col("n_levels"))
    return cardinalities(lf).groupBy(*lf.keys).agg(
        F.avg(levels).alias("mean_levels"),
        F.max(levels).alias("max_levels"),
        F.avg((levels > many).cast("double")).alias("share_many_levels"),
    )


def _quantile(values: Column, share: float) -> Column:
    """Linear quantile of a short sorted array without nulls; null if it is empty."""
    at = (F.size(values) - 1) * F.lit(share)
    low = F.floor(at).cast("int")
    high = F.ceil(at).cast("int")
    mixed = values[low] + (values[high] - values[low]) * (at - low)
    return F.when(F.size(values) > 0, mixed)


def tails(lf: LabelledFrame) -> DataFrame:
    """Median and ninth decile over numeric columns of absolute skew and of excess kurtosis (population).

    Moments are centred while they are merged. Skew needs three values and kurtosis four; a column without
    spread has neither.
    """
    facts = []
    for k, c in enumerate(lf.numeric):
        value = F.col(c).cast("double")
        # Where all values are equal, rounding may still leave a spread.
        spread = F.min(value) < F.max(value)
        facts += [
            F.when(spread & (F.count(value) >= 3), F.skewness(value)).alias(f"s{k}"),
            F.when(spread & (F.count(value) >= 4), F.kurtosis(value)).alias(f"k{k}"),
        ]
    per = lf.df.groupBy(*lf.keys).agg(F.count(F.lit(1)).alias("rows"), *facts)
    width = range(len(lf.numeric))
    columns = {
        "skew": F.array(*[F.abs(F.col(f"s{k}")) for k in width]).cast("array<double>"),
        "kurtosis": F.array(*[F.col(f"k{k}") for k in width]).cast("array<double>"),
    }
    arrays = per.select(
        *lf.keys, *[F.array_sort(F.filter(v, lambda x: x.isNotNull() & ~F.isnan(x))).alias(k) for k, v in columns.items()]
    )
    return arrays.select(
        *lf.keys,
        F.size("skew").alias("n_columns"),
        _quantile(F.col("skew"), 0.5).alias("median_abs_skew"),
        _quantile(F.col("skew"), 0.9).alias("p90_abs_skew"),
        _quantile(F.col("kurtosis"), 0.5).alias("median_kurtosis"),
        _quantile(F.col("kurtosis"), 0.9).alias("p90_kurtosis"),
    )


_SUMS = ("n", "x", "y", "xx", "yy", "xy")


def _products(width: int, block: int):
    """Sums over pairs of column blocks, per dataset, of rows (key, values)."""
    starts = list(range(0, width, block))

    def flushed(held: dict) -> pa.RecordBatch:
        names, first, second, sums = [], [], [], []
        for (key, a, b), total in held.items():
            names.append(key)
            first.append(a)
            second.append(b)
            sums.append(np.stack([total[s] for s in _SUMS]).ravel())
        return pa.RecordBatch.from_arrays(
            [
                pa.array(names, pa.string()), pa.array(first, pa.int32()), pa.array(second, pa.int32()),
                pa.array(sums, pa.list_(pa.float64())),
            ],
            ["key", "a", "b", "sums"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.asarray(batch.column(0).to_pylist(), object)
            values = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(float)
            values = values.reshape(batch.num_rows, width)
            order = np.argsort(keys.astype(str), kind="stable")
            names, first = np.unique(keys[order].astype(str), return_index=True)
            for name, rows in zip(names.tolist(), np.split(order, first[1:]), strict=True):
                part = values[rows]
                seen = ~np.isnan(part)
                zero = np.where(seen, part, 0.0)
                seen = seen.astype(float)
                for i, a in enumerate(starts):
                    p, m = zero[:, a : a + block], seen[:, a : a + block]
                    for b in starts[i:]:
                        q, w = zero[:, b : b + block], seen[:, b : b + block]
                        new = {
                            "n": m.T @ w, "x": p.T @ w, "y": m.T @ q,
                            "xx": (p * p).T @ w, "yy": m.T @ (q * q), "xy": p.T @ q,
                        }
                        own = held.get((name, a, b))
                        held[name, a, b] = new if own is None else {s: own[s] + new[s] for s in _SUMS}
                        if len(held) >= HELD_BLOCKS:
                            yield flushed(held)
                            held.clear()
        if held:
            yield flushed(held)

    return run


def pair_correlations(lf: LabelledFrame, block: int = BLOCK) -> DataFrame:
    """(key, i, j, n, correlation) for every pair of numeric columns, rows with both present.

    Values are first centred by their column's mean. Tasks add up products of column blocks (``block``
    columns by as many), so their memory doesn't grow with the number of columns beyond a row's; every pair
    of columns then sums one number per task and kind. No cap on rows or columns. A pair without spread has a
    null correlation, and so has one with fewer than three rows.
    """
    width = len(lf.numeric)
    if width < 2:
        raise ValueError("Need at least two numeric columns.")
    if len(lf.keys) != 1:
        raise ValueError("One key column is needed.")
    key = lf.keys[0]
    means = lf.df.groupBy(key).agg(*[F.avg(c).alias(f"m{k}") for k, c in enumerate(lf.numeric)])
    centred = F.array(*[F.col(c).cast("double") - F.col(f"m{k}") for k, c in enumerate(lf.numeric)])
    rows = lf.df.join(means, key).select(F.col(key).cast("string").alias("key"), centred.alias("values"))
    parts = rows.mapInArrow(_products(width, block), "key string, a int, b int, sums array<double>")
    wide = lambda start: F.least(F.lit(block), F.lit(width) - F.col(start))
    cells = wide("a") * wide("b")
    place = F.explode(F.sequence(F.lit(0), cells - 1)).alias("at")
    long = parts.select("key", "a", "b", place, cells.alias("cells"), wide("b").alias("across"), "sums")
    i = F.col("a") + F.floor(F.col("at") / F.col("across")).cast("int")
    j = F.col("b") + F.col("at") % F.col("across")
    taken = [F.get("sums", F.col("at") + F.col("cells") * k).alias(s) for k, s in enumerate(_SUMS)]
    pairs = long.select("key", i.alias("i"), j.alias("j"), *taken).where("i < j")
    summed = pairs.groupBy("key", "i", "j").agg(*[F.sum(s).alias(s) for s in _SUMS])
    n = F.nullif(F.col("n"), F.lit(0.0))
    spread = [F.greatest(F.col(s * 2) - F.col(s) * F.col(s) / n, F.lit(0.0)) for s in "xy"]
    base = F.sqrt(spread[0]) * F.sqrt(spread[1])
    # Rounding leaves about 1e-16 of the squares where there is no spread.
    flat = (spread[0] <= 1e-13 * F.col("xx")) | (spread[1] <= 1e-13 * F.col("yy")) | (base == 0)
    value = (F.col("xy") - F.col("x") * F.col("y") / n) / F.nullif(base, F.lit(0.0))
    value = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), value))
    return summed.select(
        F.col("key").alias(key), "i", "j", F.col("n").cast("bigint").alias("n"),
        F.when(~flat & (F.col("n") >= 3), value).alias("correlation"),
    )


def correlation_summary(lf: LabelledFrame, strong: float = STRONG, block: int = BLOCK) -> DataFrame:
    """Mean and largest absolute correlation, and the share of pairs above ``strong``."""
    size = F.abs("correlation")
    if len(lf.numeric) < 2:
        none = F.lit(None).cast("double")
        return lf.df.select(*lf.keys).distinct().select(
            *lf.keys, F.lit(0).cast("bigint").alias("n_pairs"),
            *[none.alias(c) for c in ("mean_abs_correlation", "max_abs_correlation", "share_strong")],
        )
    return pair_correlations(lf, block).groupBy(*lf.keys).agg(
        F.count("correlation").alias("n_pairs"),
        F.avg(size).alias("mean_abs_correlation"),
        F.max(size).alias("max_abs_correlation"),
        F.avg(F.when(size.isNotNull(), (size > strong).cast("double"))).alias("share_strong"),
    )


def basic_extras(lf: LabelledFrame) -> DataFrame:
    """Further descriptors from counts, ranges and moments of columns; one row per dataset.

    log_rows, log_features; numeric, categorical and binary columns (exactly two values present); share of
    columns with gaps and the largest share of gaps; target entropy in nats and relative to its maximum;
    median of ln(1 + variance) and share of nearly constant numeric columns; surplus duplicates; share of
    zeros among present numbers.
    """
    keys, p = list(lf.keys), len(lf.features)
    rows = F.count(F.lit(1))
    facts = [rows.alias("n")]
    for k, c in enumerate(lf.features):
        facts.append((rows - F.count(c)).alias(f"gaps{k}"))
    for k, c in enumerate(lf.numeric):
        value = F.col(c).cast("double")
        facts += [
            F.min(value).alias(f"low{k}"), F.max(value).alias(f"high{k}"), F.var_pop(value).alias(f"m{k}"),
            F.avg(value * value).alias(f"q{k}"), F.count_if(value == 0).alias(f"z{k}"),
        ]
    stats = lf.df.groupBy(*keys).agg(*facts)
    # Two values are the range of a column with nothing between; this takes a second scan, no distinct count.
    between = [
        F.count_if((F.col(c) > F.col(f"low{k}")) & (F.col(c) < F.col(f"high{k}"))).alias(f"between{k}")
        for k, c in enumerate(lf.numeric)
    ]
    bounds = stats.select(*keys, *[F.col(f"{e}{k}") for k in range(len(lf.numeric)) for e in ("low", "high")])
    inner = lf.df.join(bounds, keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), *between).drop("__n")
    levels = cardinalities(lf).groupBy(*keys).agg(F.count_if(F.col("column").isNotNull() & (F.col("n_levels") == 2)).alias("binary_levels"))
    classes = lf.df.where(F.col(lf.target).isNotNull()).groupBy(*keys, lf.target).agg(rows.alias("__copies"))
    copies = F.col("__copies")
    entropy = F.log(F.sum(copies)) - F.sum(copies * F.log(copies)) / F.sum(copies)
    classes = classes.groupBy(*keys).agg(entropy.alias("target_entropy"), F.count(F.lit(1)).alias("classes"))
    signatures = lf.df.groupBy(*keys, *lf.features).agg(rows.alias("__copies")).groupBy(*keys)
    signatures = signatures.agg(((F.sum(copies) - F.count(F.lit(1))) / F.sum(copies)).alias("surplus_duplicates"))
    joined = stats.join(inner, keys).join(levels, keys).join(signatures, keys).join(classes, keys, "left")
    total = lambda cells: sum(cells, F.lit(0))
    numbers = range(len(lf.numeric))
    seen = F.lit(len(lf.numeric)) * F.col("n") - total(F.col(f"gaps{k}") for k in numbers)
    two = lambda k: (F.col(f"low{k}") < F.col(f"high{k}")) & (F.col(f"between{k}") == 0)
    binary = total(F.coalesce(two(k).cast("int"), F.lit(0)) for k in numbers)
    spread = F.array_sort(F.filter(F.array(*[F.log1p(f"m{k}") for k in numbers]).cast("array<double>"), lambda v: v.isNotNull()))
    known = total(F.col(f"m{k}").isNotNull().cast("int") for k in numbers)
    still = total(F.coalesce((F.col(f"m{k}") / (F.col(f"q{k}") + 1e-12) < 1e-8).cast("int"), F.lit(0)) for k in numbers)
    gaps = [F.col(f"gaps{k}") / F.col("n") for k in range(p)]
    return joined.select(
        *keys,
        F.log1p("n").alias("log_rows"),
        F.log1p(F.lit(float(p))).alias("log_features"),
        F.lit(len(lf.numeric)).alias("n_numeric"),
        F.lit(len(lf.categorical)).alias("n_categorical"),
        (binary + F.coalesce("binary_levels", F.lit(0))).cast("bigint").alias("n_binary"),
        (total((g > 0).cast("int") for g in gaps) / p).alias("gap_columns_share"),
        (F.greatest(*gaps) if p > 1 else gaps[0]).alias("largest_gap_share"),
        "target_entropy",
        F.when(F.col("classes") > 1, F.col("target_entropy") / F.log("classes")).alias("relative_entropy"),
        _quantile(spread, 0.5).alias("median_log_variance"),
        (still / F.nullif(known, F.lit(0))).alias("near_constant_share"),
        "surplus_duplicates",
        (total(F.col(f"z{k}") for k in numbers) / F.nullif(seen, F.lit(0))).alias("zero_share"),
    )


def sampled_descriptors(described: DataFrame, keys: tuple[str, ...], names: tuple[str, ...]) -> DataFrame:
    """Mean descriptors over the samples of each dataset, as recorded for tables that were benchmarked.

    ``described`` has one row per dataset and sample, for instance descriptors of the training parts of
    three seeded splits; a sample that cannot be described makes the mean null.
    """
    complete = F.count_if(F.col("status") != "ok") == 0
    return described.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_samples_drawn"), *[F.when(complete, F.avg(c)).alias(c) for c in names]
    )
