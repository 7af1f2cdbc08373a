"""Regression trees for many training sets at once: every row but one fold's, for each fold.

Trees of all folds grow together, level by level. Rows are counted once per (path, feature, bin, fold),
where a path is a chain of conditions; what a fold's own tree sees is the total of all folds minus its own
counts. Trees of different folds share a path as long as they split alike, so rows are not repeated per
fold. No fold name reaches the driver, and nothing depends on how rows are partitioned: sums are exact
decimals before they become doubles.

A feature's values are bins: up to ``BINS`` distinct values each is its own, beyond that bins hold equal
numbers of distinct values. A split lies midway between the neighbouring bins that training rows of the
node have; the largest reduction of squared error wins, then the first feature and the lowest split.
Forests draw a multiplicity for every (tree, dataset) from a hash, Poisson with mean one.

Rows may belong to groups, which share nothing; a dataset is one row of its group. The trees of a group of
up to ``HELD`` rows are grown a few at a time by tasks that hold its rows; those of a larger group by counts
over all tasks, level by level. Both find the same trees.
"""

from __future__ import annotations

import ctypes
import hashlib
import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.ranks import numbered
from ..session import stored

#: Cells of a feature (a row each, if names are unique) that one task may hold: some 60 MB with ten features.
HELD = 500_000
TREES_PER_TASK = 10
BINS = 1024
LEAST_ROWS = 2
#: Digits behind the point to which targets are summed.
EXACT = "decimal(38,15)"
#: Targets below this are whole numbers of 64 bits with the digits of ``EXACT``, twelve times over.
LARGEST = 700

#: Where a row is: its group, its tree and the conditions it meets there.
PLACE = ["group", "tree", "path"]
ALL = "all"


@dataclass(frozen=True)
class Shape:
    trees: int
    depth: int
    bootstrap: bool
    seed: int = 42


SHAPES = {"decision_tree": Shape(1, 3, False), "random_forest": Shape(300, 5, True)}


#: Shares up to which a dataset is drawn at most 0, 1, ... times.
DRAWN = list(accumulate(math.exp(-1) / math.factorial(k) for k in range(12)))


def bootstrap_weight(seed: int, tree: Column, name: Column) -> Column:
    """How often a dataset is drawn for a tree."""
    text = F.concat_ws("|", F.lit(str(seed)), tree.cast("string"), name)
    share = (F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    return sum(((share > upto).cast("int") for upto in DRAWN), F.lit(0))


def _weights(seed: int, tree: int, names: Sequence[bytes]) -> np.ndarray:
    """The same for many names."""
    start = f"{seed}|{tree}|".encode()
    digests = b"".join([hashlib.md5(start + n, usedforsecurity=False).digest() for n in names])
    share = (np.frombuffer(digests, ">u4")[::4] + 0.5) / 4294967296.0
    return np.searchsorted(DRAWN, share)


def _binned(rows: DataFrame, features: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows with their bin per feature, and (group, feature, bin, low, high)."""
    # 0.0 and -0.0 are one value.
    cells = F.posexplode(F.array(*[F.col(c).cast("double") + F.lit(0.0) for c in features]))
    long = rows.select("group", "dataset", cells.alias("feature", "value"))
    values = long.select("group", "feature", "value").distinct()
    ranked = numbered(values, [F.col("group"), F.col("feature"), F.col("value")])
    facts = ranked.groupBy("group", "feature").agg(F.min("number").alias("first"), F.count(F.lit(1)).alias("distinct"))
    place = (F.col("number") - F.col("first")) * BINS
    known = stored(
        ranked.join(facts, ["group", "feature"]).select(
            "group", "feature", "value", F.floor(place / F.greatest("distinct", F.lit(BINS))).cast("int").alias("bin")
        )
    )
    edges = known.groupBy("group", "feature", "bin").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    entry = F.array_sort(F.collect_list(F.struct("feature", "bin", "value")))
    per_row = long.join(known, ["group", "feature", "value"]).groupBy("group", "dataset").agg(entry.alias("cells"))
    out = rows.join(per_row, ["group", "dataset"]).select("group", "dataset", "fold", "y", "cells")
    return out, edges


def _best_split(total: tuple, own: tuple) -> tuple[float, int, int] | None:
    """(gain, left, right) of the best split of the rows in ``total`` that aren't in ``own``, if there is one.

    Both are columns (bin, m, w, s) in order of bins: rows, weight and weighted target.
    """
    bins, *sums = total
    if len(own[0]):
        at = np.searchsorted(bins, own[0])
        for k, mine in enumerate(own[1:]):
            sums[k] = sums[k].copy()
            sums[k][at] -= mine
        held = sums[0] > 0
        bins, sums = bins[held], [x[held] for x in sums]
    if len(bins) < 2:
        return None
    m, w, s = (np.cumsum(x) for x in sums)
    # A side without weight gives no error; such a side has no rows either.
    side = lambda s, w: s * s / np.maximum(w, 1).astype(np.float64)
    gain = side(s[:-1], w[:-1]) + side(s[-1] - s[:-1], w[-1] - w[:-1])
    gain[(m[:-1] < LEAST_ROWS) | (m[-1] - m[:-1] < LEAST_ROWS)] = -np.inf
    best = int(np.argmax(gain))
    return None if gain[best] == -np.inf else (float(gain[best]), int(bins[best]), int(bins[best + 1]))


def _cells_of(column: pa.Array) -> Callable[[int], tuple]:
    """The cells of a row of a list column as arrays; a null is an empty list."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    ends, cells = column.offsets.to_numpy(), column.values
    parts = [cells.field(c).to_numpy(zero_copy_only=False) for c in ("bin", "m", "w", "s")]
    known = column.is_valid().to_numpy(zero_copy_only=False)
    return lambda i: tuple(x[ends[i] : ends[i + 1]] if known[i] else x[:0] for x in parts)


def _with_splits(names: Sequence[str]):
    """Rows with cells ``total`` and ``own`` to rows with their best split; rows without one are left out."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, own = _cells_of(batch.column("total")), _cells_of(batch.column("own"))
            splits = [_best_split(total(i), own(i)) for i in range(batch.num_rows)]
            rows = [i for i, s in enumerate(splits) if s is not None]
            kept = batch.select(list(names)).take(pa.array(rows, pa.int64()))
            gain, left, right = zip(*[splits[i] for i in rows], strict=True) if rows else ((), (), ())
            columns = [pa.array(gain, pa.float64()), pa.array(left, pa.int32()), pa.array(right, pa.int32())]
            yield pa.RecordBatch.from_arrays([*kept.columns, *columns], [*names, "gain", "left", "right"])

    return found


def _totals(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sums per path, and per path and fold."""
    drawn = members.where("w > 0")
    exact = F.sum(F.col("y").cast(EXACT) * F.col("w")).alias("s")
    own = stored(
        drawn.groupBy(*PLACE, "fold").agg(F.count(F.lit(1)).alias("m"), F.sum("w").alias("w"), exact)
    )
    add = [F.sum("m").alias("m"), F.sum("w").alias("w"), F.sum("s").cast("double").alias("s")]
    whole = own.groupBy(*PLACE).agg(*add)
    kinds = {"m": "bigint", "w": "bigint", "s": "double"}
    return whole, own.select(*PLACE, "fold", *[F.col(c).cast(k).alias(f"own_{c}") for c, k in kinds.items()])


def _histograms(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cells per (tree, path, feature), of all rows and of each fold; at most BINS cells a row."""
    drawn = members.where("w > 0")
    each = drawn.select(*PLACE, "fold", "w", "y", F.explode("cells").alias("c"))
    keys = [*PLACE, "feature", "bin"]
    exact = F.sum(F.col("y").cast(EXACT) * F.col("w")).alias("s")
    own = stored(
        each.select(*PLACE, "fold", "w", "y", "c.feature", "c.bin")
        .groupBy(*keys, "fold")
        .agg(F.count(F.lit(1)).alias("m"), F.sum("w").alias("w"), exact)
    )
    cell = F.struct("bin", "m", "w", F.col("s").cast("double").alias("s"))
    cells = F.array_sort(F.collect_list(cell))
    whole = own.groupBy(*keys).agg(F.sum("m").alias("m"), F.sum("w").alias("w"), F.sum("s").alias("s"))
    return (
        whole.groupBy(*PLACE, "feature").agg(cells.alias("total")),
        own.groupBy(*PLACE, "feature", "fold").agg(cells.alias("own")),
    )


class _Held:
    """The rows of one group in arrays, with the cells (row, bin) of every feature."""

    def __init__(self, table: pa.Table, width: int, limit: int, unit: int):
        names = table.column("dataset").combine_chunks().dictionary_encode()
        code, n = names.indices.to_numpy(), len(table)
        self.names, self.code = [x.encode() for x in names.dictionary.to_pylist()], code
        y = table.column("y").combine_chunks()
        self.y = np.where(y.is_valid().to_numpy(zero_copy_only=False), np.frombuffer(y.buffers()[1], "<i8")[2 * y.offset :][: 2 * n : 2], 0)
        self.unit = unit
        # Rows of one name share their cells, as many as there are such rows.
        counts = np.bincount(code, minlength=len(self.names))
        row = twin = np.arange(n, dtype=np.int32)
        if alike := n > len(counts):
            order, starts = np.argsort(code, kind="stable"), np.cumsum(counts) - counts
            row = np.repeat(row, counts[code])
            each = np.arange(len(row)) - np.repeat(np.cumsum(counts[code]) - counts[code], counts[code])
            twin = order[starts[code[row]] + each].astype(np.int32)
        self.value, self.known, self.cells, self.edges = [], [], [], []
        for k in range(width):
            column = table.column(f"x{k}").combine_chunks()
            valid, value = column.is_valid().to_numpy(zero_copy_only=False), column.fill_null(math.nan).to_numpy()
            levels, at = np.unique(value[valid], return_inverse=True)
            # A missing value has a number, but no cell.
            number = np.arange(len(levels)) + int(not valid.all())
            bins = np.floor(number * limit / max(len(levels) + int(not valid.all()), limit)).astype(np.int64)
            starts_of = np.searchsorted(bins, np.arange(limit + 1))
            held = np.minimum(starts_of, max(len(levels) - 1, 0))
            self.edges.append((levels[held[:-1]], levels[held[1:] - (starts_of[1:] < len(levels))]) if len(levels) else None)
            bin_of = np.zeros(n, np.int32 if limit >> 15 else np.int16)
            bin_of[valid] = bins[at]
            has = valid[twin]
            # Features without missing values share one array of rows.
            self.cells.append((row, bin_of if twin is row else bin_of[twin]) if has.all() else (row[has], bin_of[twin[has]]))
            if alike:
                first = np.fmin.reduceat(value[order], starts)
                valid = np.logical_or.reduceat(valid[order], starts)[code]
                value = first[code]
            self.value.append(value)
            self.known.append(valid)
        self.some = np.logical_or.reduce(self.known)
        self.bins = 1 + max((int(b.max()) for _, b in self.cells if len(b)), default=0)

    def drawn(self, w: np.ndarray) -> np.ndarray:
        """Weighted targets in units of the last digit that decimals keep, rounded half up as they are."""
        size = np.abs(self.y) * w
        return (np.sign(self.y) * ((size + self.unit // 2) // self.unit)).astype(np.float64)

    def drawn_cells(self, w: np.ndarray) -> list[tuple]:
        of, cells = {}, []
        for row, bins in self.cells:
            if id(row) not in of:
                inside = w[row] > 0
                of[id(row)] = inside, row[inside]
            inside, held = of[id(row)]
            cells.append((held, bins[inside]))
        return cells

    def between(self, feature: int, left: int, right: int) -> float:
        low, high = self.edges[feature][0][right], self.edges[feature][1][left]
        middle = (high + low) / 2
        # The midpoint of neighbouring doubles may be the upper one; the lower keeps both sides apart.
        return float(middle if middle < low else high)


def _grown(rows: _Held, depth: int, scale: float, w: np.ndarray, t: np.ndarray, cells: list, own: np.ndarray):
    """The nodes of one tree that does not see the rows ``own``, and the leaf value of each of those rows.

    A tree's own sums are those of all rows minus those of ``own``, as in counts over all tasks. Values are
    NaN where a leaf has no weight; rows are None if the tree has no root.
    """
    held, seen = np.flatnonzero((w > 0) & rows.some), np.zeros(len(w), bool)
    seen[own] = True
    at = np.zeros(len(w), np.int64)
    at[held] = at[own] = 1
    nodes, told = [], np.full(len(own), math.nan)
    mine = held[seen[held]]
    if not len(held):
        return nodes, None
    for level in range(depth + 1):
        first = 1 << level

        def sums(index: np.ndarray) -> list[np.ndarray]:
            node = at[index]
            index, node = index[node > 0], node[node > 0] - first  # noqa: B023
            return [np.bincount(node, x, first) for x in (None, w[index], t[index])]  # noqa: B023

        (m, weight, s), less = sums(held), sums(mine)
        exists = m > 0
        rest, weight = m - less[0], weight - less[1]
        with np.errstate(divide="ignore", invalid="ignore"):
            value = np.where(weight > 0, (s / scale - less[2] / scale) / weight, math.nan)
        split = {}
        open_ = np.flatnonzero(exists & (rest >= 2 * LEAST_ROWS)) if level < depth else []
        if len(open_):
            for node, found in zip(open_, _splits(rows, at, first, open_, cells, w, t, seen, len(mine) > 0, scale), strict=True):
                if found is not None:
                    split[int(node)] = (found[0], rows.between(*found))
        for node in np.flatnonzero(exists):
            feature, threshold = split.get(int(node), (None, None))
            nodes.append((first + int(node), feature, threshold, float(value[node])))
        here = np.flatnonzero(at)
        node = at[here] - first
        to = np.zeros(len(here), np.int64)
        for k, (feature, threshold) in split.items():
            inside = node == k
            index = here[inside]
            if not rows.known[feature][index].all():
                raise ValueError("A row has no value of a feature that its tree splits by.")
            to[inside] = 2 * (first + k) + ~(rows.value[feature][index] <= threshold)
        ended = (at[own] > 0) & ~np.isin(at[own] - first, list(split))
        told[ended] = value[at[own[ended]] - first]
        at[here] = to
        if not split:
            break
    return nodes, told


def _splits(rows, at, first, open_, cells, w, t, seen, less: bool, scale: float) -> list:
    """(feature, left, right) of the best split of each open node of a level, None without one."""
    place = np.full(first, -1)
    place[open_] = np.arange(len(open_))
    shape = (len(open_), len(cells), rows.bins)
    m, weight, s = (np.zeros(shape) for _ in range(3))
    for k, (row, bins) in enumerate(cells):
        node = at[row]
        node = np.where(node > 0, place[node - first], -1)
        inside = node >= 0
        row, key = row[inside], node[inside] * rows.bins + bins[inside]

        def counted(row: np.ndarray, key: np.ndarray) -> list[np.ndarray]:
            return [np.bincount(key, x, shape[0] * shape[2]).reshape(shape[0], shape[2]) for x in (None, w[row], t[row])]

        m[:, k], weight[:, k], s[:, k] = counted(row, key)
        s[:, k] /= scale
        if less:
            own = seen[row]
            taken = counted(row[own], key[own])
            m[:, k] -= taken[0]
            weight[:, k] -= taken[1]
            s[:, k] -= taken[2] / scale
    present = m > 0
    m, weight, s = (np.cumsum(x, axis=2) for x in (m, weight, s))
    side = lambda s, w: s * s / np.maximum(w, 1)
    gain = side(s, weight) + side(s[:, :, -1:] - s, weight[:, :, -1:] - weight)
    gain[~present | (m < LEAST_ROWS) | (m[:, :, -1:] - m < LEAST_ROWS)] = -np.inf
    flat = gain.reshape(len(open_), -1)
    found = []
    for i, best in enumerate(np.argmax(flat, axis=1)):
        feature, left = divmod(int(best), rows.bins)
        right = left + 1 + int(np.argmax(present[i, feature, left + 1 :])) if left + 1 < rows.bins else left
        found.append(None if flat[i, best] == -np.inf else (feature, left, right))
    return found


def _return_memory() -> None:
    """Give back what was freed: Spark keeps its Python workers between tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def _task(shape: Shape, width: int, limit: int, scale: int, schema: pa.Schema):
    """Rows and folds of a group to nodes of a few trees and sums of leaf values of its rows."""

    def grown(key: tuple, table: pa.Table, folds: pa.Table) -> pa.Table:
        if not table.num_rows or not folds.num_rows:
            return schema.empty_table()
        rows = _Held(table, width, limit, 10 ** (15 - scale))
        wanted = folds.column("wanted").to_pylist()
        of = table.column("fold").combine_chunks().dictionary_encode()
        code = {f: k for k, f in enumerate(dict.fromkeys(f for f in wanted if f is not None))}
        known = np.array([*(code.get(f, -1) for f in of.dictionary.to_pylist()), -1])
        fold = known[of.indices.fill_null(-1).to_numpy()]
        own = {f: np.flatnonzero((fold == k) & rows.some) for f, k in code.items()}
        total, n, reached = np.zeros(len(fold)), np.zeros(len(fold), np.int64), np.zeros(len(fold), bool)
        out: list[tuple] = []
        part = key[1].as_py()
        for tree in range(part * TREES_PER_TASK, min((part + 1) * TREES_PER_TASK, shape.trees)):
            w = _weights(shape.seed, tree, rows.names)[rows.code] if shape.bootstrap else np.ones(len(fold), np.int64)
            t = rows.drawn(w)
            cells = rows.drawn_cells(w)
            for f in wanted:
                # Nothing is known of a fold without a name: its trees have a root only.
                mine = own.get(f, np.empty(0, np.int64))
                nodes, told = _grown(rows, shape.depth if f is not None else 0, float(10**scale), w, t, cells, mine)
                out += [(f, tree, *node) for node in nodes]
                if told is not None:
                    reached[mine] = True
                    total[mine] += np.nan_to_num(told)
                    n[mine] += ~np.isnan(told)
            del w, t, cells
            _return_memory()
        f, tree, node, feature, threshold, value = ([*x] for x in zip(*out, strict=True)) if out else ([],) * 6
        value = [None if math.isnan(v) else v for v in value]
        told = np.flatnonzero(reached)
        plain = {"fold": f, "tree": tree, "node": node, "feature": feature, "threshold": threshold, "value": value}
        first = pa.table({k: pa.array(v, schema.field(k).type) for k, v in plain.items()})
        facts = {"value": total[told], "n": n[told]}
        second = pa.table({"dataset": table.column("dataset").take(pa.array(told))} | {k: pa.array(v, schema.field(k).type) for k, v in facts.items()})
        both = pa.concat_tables([first, second], promote_options="default")
        both = both.append_column("group", pa.array([key[0].as_py()] * len(both), schema.field("group").type))
        both = both.append_column("part", pa.array([part] * len(both), pa.int32()))
        return both.select(schema.names).cast(schema)

    return grown


def _digits(rows: DataFrame) -> int:
    """Digits behind the point that a target keeps once it is multiplied by its weight."""
    return rows.select(F.col("y").cast(EXACT) * F.size(F.array("y"))).schema[0].dataType.scale


def _grow_held(rows: DataFrame, features: Sequence[str], shape: Shape, folds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Trees of groups whose rows fit into a task, ``TREES_PER_TASK`` by each."""
    parts = -(-shape.trees // TREES_PER_TASK)
    part = F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    keys = ["group", "part"]
    deal = max(8 * parts, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # 0.0 and -0.0 are one value.
    values = [(F.col(c).cast("double") + F.lit(0.0)).alias(f"x{k}") for k, c in enumerate(features)]
    known = rows.where("group IS NOT NULL AND dataset IS NOT NULL")
    known = known.select("group", F.col("dataset").cast("string").alias("dataset"), "fold", F.col("y").cast(EXACT).alias("y"), *values, part.alias("part"))
    left = known.repartition(deal, *keys).groupBy(*keys)
    # Folds often come from the rows, whose columns need other names then.
    asked = folds.where("group IS NOT NULL").select(F.col("group").alias("of"), F.col("fold").alias("wanted"), part.alias("at"))
    right = asked.repartition(deal, "of", "at").groupBy("of", "at")
    kind = {c: rows.schema[c].dataType.simpleString() for c in ("group", "dataset", "fold")}
    schema = (
        f"group {kind['group']}, fold {kind['fold']}, tree int, node int, feature int, threshold double, value double, "
        "dataset string, part int, n bigint"
    )
    task = _task(shape, len(features), BINS, _digits(rows), to_arrow_schema(StructType.fromDDL(schema)))
    found = stored(left.cogroup(right).applyInArrow(task, schema))
    nodes = found.where("node IS NOT NULL").select("group", "fold", "tree", "node", "feature", "threshold", "value")
    sums = F.array_sort(F.collect_list(F.struct("part", "value", "n")))
    told = found.where("node IS NULL").groupBy("group", "dataset").agg(sums.alias("sums"))
    add = lambda c, zero: F.aggregate("sums", zero, lambda a, x: a + x[c])
    mean = add("value", F.lit(0.0)) / F.nullif(add("n", F.lit(0).cast("bigint")), F.lit(0))
    return nodes, told.select("group", F.col("dataset").cast(kind["dataset"]).alias("dataset"), mean.alias("predicted"))


def grow(
    rows: DataFrame, features: Sequence[str], shape: Shape, folds: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Trees for every row of ``folds`` (group, fold), each grown without the rows of its fold.

    ``rows`` holds group, dataset, fold, y and the features. Returns the nodes (group, fold, tree, node,
    feature, threshold, value), numbered from 1 with children 2n and 2n + 1, and for every row of a fold
    the mean leaf value (group, dataset, predicted) of its fold's trees.
    """
    # Held sums are whole numbers that doubles hold exactly: targets times weights in units of the last digit.
    bound = 2**53 / (13 * 10 ** _digits(rows))
    each = rows.groupBy("group", "dataset").agg(F.count(F.lit(1)).alias("n"), F.max(F.abs("y")).alias("top"))
    facts = each.groupBy("group").agg(F.sum(F.col("n") * F.col("n")).alias("cells"), F.max("top").alias("top"))
    top = F.coalesce("top", F.lit(0))
    fits = (F.col("cells") <= HELD) & (top < LARGEST) & (top * F.col("cells") < bound)
    large = stored(facts.where(~fits).select("group"))
    if large.isEmpty():
        return _grow_held(rows, features, shape, folds)
    apart = [(rows.join(large, "group", how), folds.join(large, "group", how)) for how in ("left_anti", "left_semi")]
    found = [
        kind(r, features, shape, f) for kind, (r, f) in zip((_grow_held, _grow_spread), apart, strict=True)
    ]
    return found[0][0].unionByName(found[1][0]), found[0][1].unionByName(found[1][1])


def _grow_spread(rows: DataFrame, features: Sequence[str], shape: Shape, folds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Trees of groups of any size from counts of cells, all trees a level at a time."""
    binned, edges = _binned(rows, features)
    edges = stored(edges)
    tree = F.explode(F.sequence(F.lit(0), F.lit(shape.trees - 1))).alias("tree")
    members = binned.select("*", tree, F.lit("").alias("path"))
    weight = bootstrap_weight(shape.seed, F.col("tree"), F.col("dataset")) if shape.bootstrap else F.lit(1)
    members = stored(members.withColumn("w", weight))
    models = stored(folds.select("group", "fold", tree, F.lit(1).alias("node"), F.lit("").alias("path")))
    nodes: DataFrame | None = None
    leaves: DataFrame | None = None
    for level in range(shape.depth + 1):
        whole, own = _totals(members)
        at = PLACE
        valued = models.join(whole, at).join(own, [*at, "fold"], "left")
        rest = {c: F.col(c) - F.coalesce(f"own_{c}", F.lit(0)) for c in "mws"}
        valued = valued.select("fold", "node", *at, rest["m"].alias("m"), (rest["s"] / F.nullif(rest["w"], F.lit(0))).alias("value"))
        if level < shape.depth:
            total, mine = _histograms(members)
            candidates = valued.where(F.col("m") >= 2 * LEAST_ROWS).join(total, at)
            candidates = candidates.join(mine, [*at, "feature", "fold"], "left")
            names = ["fold", "node", *at, "feature"]
            kinds = ", ".join(f"{c} {candidates.schema[c].dataType.simpleString()}" for c in names)
            candidates = candidates.select(*names, "total", "own").mapInArrow(
                _with_splits(names), f"{kinds}, gain double, left int, right int"
            )
            order = F.struct("gain", (-F.col("feature")).alias("first"), "left", "right")
            best = candidates.groupBy("fold", "node", *at).agg(F.max(order).alias("b"))
            best = best.select("fold", "node", *at, (-F.col("b.first")).alias("feature"), "b.left", "b.right")
            left = edges.select("group", "feature", F.col("bin").alias("left"), "high")
            right = edges.select("group", "feature", F.col("bin").alias("right"), "low")
            best = best.join(left, ["group", "feature", "left"]).join(right, ["group", "feature", "right"])
            middle = (F.col("high") + F.col("low")) / 2
            # The midpoint of neighbouring doubles may be the upper one; the lower keeps both sides apart.
            threshold = F.when(middle < F.col("low"), middle).otherwise(F.col("high"))
            best = best.select("fold", "node", *at, "feature", threshold.alias("threshold"))
            found = stored(valued.join(best, ["fold", "node", *at], "left"))
        else:
            none = [F.lit(None).cast("int").alias("feature"), F.lit(None).cast("double").alias("threshold")]
            found = stored(valued.select("*", *none))
        kept = found.select("group", "fold", "tree", "node", "feature", "threshold", "value")
        nodes = kept if nodes is None else nodes.union(kept)
        ends = found.where("feature IS NULL").select("fold", *at, "value")
        reached = members.select("dataset", "fold", *at).join(ends, ["fold", *at]).select("group", "dataset", "value")
        leaves = reached if leaves is None else leaves.union(reached)
        if level == shape.depth:
            break
        splits = found.where("feature IS NOT NULL").select("fold", "node", *at, "feature", "threshold")
        sides = F.explode(F.array(F.lit(0), F.lit(1))).alias("side")

        def path(side: Column) -> Column:
            name = F.concat_ws(" ", F.col("feature").cast("string"), side.cast("string"), F.col("threshold").cast("string"))
            return F.concat("path", F.lit("/"), name)

        models = splits.select("fold", "node", *at, "feature", "threshold", sides)
        models = stored(
            models.select(
                "group", "fold", "tree", (F.col("node") * 2 + F.col("side")).alias("node"), path(F.col("side")).alias("path")
            )
        )
        ways = splits.select(*at, "feature", "threshold").distinct()
        above = F.filter("cells", lambda c: c["feature"] == F.col("feature"))[0]["value"] > F.col("threshold")
        members = stored(
            members.join(ways, at).select(
                "group", "tree", path(above.cast("int")).alias("path"), "dataset", "fold", "y", "cells", "w"
            )
        )
    predicted = leaves.groupBy("group", "dataset").agg(F.avg("value").alias("predicted"))
    return nodes, predicted


def grow_groups(rows: DataFrame, features: Sequence[str], shape: Shape) -> DataFrame:
    """The nodes of one set of trees per group of ``rows`` (group, dataset, y, features), from all its rows."""
    folds = rows.select("group", F.lit(ALL).alias("fold")).distinct()
    # No row is of that fold, so none is left out.
    whole = rows.withColumn("fold", F.lit(None).cast("string"))
    return grow(whole, features, shape, folds)[0]


def packed(nodes: DataFrame, depth: int) -> DataFrame:
    """(group, fold, trees): the nodes of each fold's trees as arrays in heap order, unused places null."""
    entry = F.struct("node", F.struct("feature", "threshold", "value").alias("here"))
    heap = F.sequence(F.lit(1), F.lit(2 ** (depth + 1) - 1))
    known = F.map_from_entries(F.collect_list(entry))
    per_tree = nodes.groupBy("group", "fold", "tree").agg(known.alias("known"))
    per_tree = per_tree.select(
        "group", "fold", "tree", F.transform(heap, lambda n: F.try_element_at(F.col("known"), n)).alias("nodes")
    )
    ordered = F.array_sort(F.collect_list(F.struct("tree", "nodes")))
    return per_tree.groupBy("group", "fold").agg(F.transform(ordered, lambda t: t["nodes"]).alias("trees"))


def walked(trees: Column, values: Column, depth: int) -> Column:
    """Mean leaf value of packed trees for an array of feature values."""

    def leaf(tree: Column) -> Column:
        def down(node: Column, _: Column) -> Column:
            here = tree[node - 1]
            below = F.when(values[here["feature"]] <= here["threshold"], node * 2).otherwise(node * 2 + 1)
            return F.when(here["feature"].isNull(), node).otherwise(below)

        return F.aggregate(
            F.sequence(F.lit(1), F.lit(depth)), F.lit(1), down, lambda node: tree[node - 1]["value"]
        )

    found = F.filter(F.transform(trees, leaf), lambda v: v.isNotNull())
    return F.aggregate(found, F.lit(0.0), lambda a, v: a + v) / F.nullif(F.size(found), F.lit(0))
