"""Vectors linked by cosine, found with a forest of random-projection trees.

1. Vectors with equal components share a node, named by a digest, so copies cost one row.
2. Each tree splits recursively at the median of a random projection. What lies within a margin of the
   split goes to both sides (spill), so a close pair is parted only if it straddles the whole margin.
   The upper part of each tree is fitted on a bounded sample; a leaf that still holds more than
   ``LEAF`` vectors is split on, level by level, by medians computed over all its rows.
3. Within a leaf all pairs are compared in double precision. A leaf that no direction can split, such as
   one dense cluster, is cut into blocks of ``BLOCK`` vectors, and each pair of blocks is a task. Nothing
   is left out and no task grows with a leaf.
4. A pair that meets in several leaves counts in the first of them only: every vector carries the
   sorted list of its leaves. A task returns one count and at most one link per vector, never pairs.
5. Components of the links give the classes.

Defined cases: a vector that is null, zero or holds null or non-finite components links with nothing and
is kept; shorter vectors count as padded with zeros; rows that repeat an id are separate vectors of one
name; a class whose ids are all null has a null id; other columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import picked, stored, takes_rows
from .components import components

TREES = 6
COSINE = 0.95
#: Vectors the trees are fitted on at most (expected number), and sampled vectors in a leaf.
SAMPLE = 16_384
LEAF_SAMPLE = 64
LEAF = 4096
BLOCK = 1024
#: Margin on each side of a split, in lengths of the longest difference of two linked unit vectors.
SPILL = 0.4
#: Both sides together may hold so many times the rows of their parent.
DENSE = 1.5


@dataclass
class Tree:
    """Split nodes by number: direction, threshold and the two children; a child below 0 is leaf -1-c."""

    directions: np.ndarray
    thresholds: np.ndarray
    children: np.ndarray

    def leaves(self, x: np.ndarray, margin: float) -> tuple[np.ndarray, np.ndarray]:
        """Row and leaf of every place a row falls to."""
        rows, found = [], []
        waiting = [(0 if len(self.thresholds) else -1, np.arange(len(x)))]
        while waiting:
            node, at = waiting.pop()
            if not len(at):
                continue
            if node < 0:
                rows.append(at)
                found.append(np.full(len(at), -1 - node))
                continue
            p = x[at] @ self.directions[node]
            waiting.append((self.children[node, 0], at[p <= self.thresholds[node] + margin]))
            waiting.append((self.children[node, 1], at[p >= self.thresholds[node] - margin]))
        if not rows:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(rows), np.concatenate(found)


def grow(x: np.ndarray, rng: np.random.Generator, margin: float, leaf: int) -> Tree:
    """A tree of random splits over unit vectors, down to ``leaf`` of them or a dense cluster."""
    directions, thresholds, children, leaves = [], [], [], 0

    def split(at: np.ndarray) -> int:
        nonlocal leaves
        if len(at) > leaf:
            for _ in range(3):
                direction = rng.standard_normal(x.shape[1])
                p = x[at] @ direction
                middle = float(np.median(p))
                left, right = at[p <= middle + margin], at[p >= middle - margin]
                if len(left) + len(right) <= DENSE * len(at):
                    node = len(thresholds)
                    directions.append(direction)
                    thresholds.append(middle)
                    children.append([0, 0])
                    children[node] = [split(left), split(right)]
                    return node
        leaves += 1
        return -leaves

    split(np.arange(len(x)))
    width = x.shape[1]
    return Tree(
        np.array(directions).reshape(-1, width), np.array(thresholds), np.array(children, int).reshape(-1, 2)
    )


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of components, zero beyond a vector's end; NaN where a component is missing."""
    rows = np.zeros((len(column), width), np.float32 if column.type.value_type == pa.float32() else float)
    for k, row in enumerate(column):
        if row.is_valid:
            values = row.values
            rows[k, : len(values)] = values.to_numpy(zero_copy_only=False)
    return rows


def _unit(rows: np.ndarray) -> np.ndarray:
    x = rows.astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _named(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in takes_rows(batches):
            rows = _matrix(batch.column(1), width)
            good = np.isfinite(rows).all(1) & (rows != 0).any(1)
            rows += 0.0  # a negative zero becomes zero
            raw = [r.tobytes() if g else None for r, g in zip(rows, good, strict=True)]
            names = [None if r is None else hashlib.blake2b(r, digest_size=16).digest() for r in raw]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, pa.binary()), pa.array(raw, pa.binary())],
                ["vec_id", "node", "vector"],
            )

    return run


def _read(column, dtype: str, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(-1, width)


def _placed(trees: list[Tree], dtype: str, width: int, margin: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in takes_rows(batches):
            x = _unit(_read(batch.column(1), dtype, width))
            for number, tree in enumerate(trees):
                rows, leaf = tree.leaves(x, margin)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows)), pa.array((number << 40) + leaf)],
                    ["node", "leaf"],
                )

    return run


def _projected(dtype: str, width: int):
    """Rows of leaves with their projection on the leaf's own random direction."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in takes_rows(batches):
            x = _unit(_read(batch.column(2), dtype, width))
            leaf = batch.column(1).to_numpy()
            p = np.zeros(len(x))
            for one in np.unique(leaf).tolist():
                at = leaf == one
                p[at] = x[at] @ np.random.default_rng(one & ((1 << 63) - 1)).standard_normal(width)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(p)], ["node", "leaf", "p"]
            )

    return run


def _refined(
    placed: DataFrame, nodes: DataFrame, dtype: str, width: int, margin: float, leaf_rows: int
) -> DataFrame:
    """Splits every leaf above ``leaf_rows`` by the median of all its rows until none can be split."""
    done: DataFrame | None = None
    while True:
        sizes = placed.groupBy("leaf").agg(F.count("*").alias("members")).where(F.col("members") > leaf_rows)
        large = stored(sizes.withColumnRenamed("leaf", "of"))
        if large.isEmpty():
            return placed if done is None else stored(placed.union(done))
        rest = placed.join(large, F.col("leaf") == F.col("of"), "left_anti")
        mine = placed.join(large, F.col("leaf") == F.col("of"), "left_semi")
        vectors = nodes.select(F.col("node").alias("name"), "vector")
        rows = mine.join(vectors, F.col("node") == F.col("name")).select("node", "leaf", "vector")
        p = stored(rows.mapInArrow(_projected(dtype, width), "node binary, leaf bigint, p double"))
        middle = stored(
            p.groupBy(F.col("leaf").alias("of")).agg(
                F.percentile_approx("p", 0.5, 1000).alias("middle"), F.count("*").alias("members")
            )
        )
        sides = F.filter(
            F.array(
                F.when(F.col("p") <= F.col("middle") + margin, F.lit(0)),
                F.when(F.col("p") >= F.col("middle") - margin, F.lit(1)),
            ),
            lambda side: side.isNotNull(),
        )
        both = p.join(middle, F.col("leaf") == F.col("of")).withColumn("sides", sides)
        made = both.groupBy("of").agg(F.sum(F.size("sides")).alias("made"), F.max("members").alias("members"))
        dense = stored(made.where(F.col("made") > DENSE * F.col("members")).select(F.col("of").alias("stuck")))
        kept = mine.join(dense, F.col("leaf") == F.col("stuck"), "left_semi")
        done = stored(kept if done is None else done.union(kept))
        split = both.join(dense, F.col("leaf") == F.col("stuck"), "left_anti")
        split = split.select("node", "leaf", F.explode("sides").alias("side"))
        split = split.select("node", F.xxhash64("leaf", "side").alias("leaf"))
        placed = stored(rest.union(split))


def _classes(count: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member of each member's class under the pairs (a, b)."""
    label = np.arange(count)
    while len(a):
        before = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        label = label[label]
        if (label == before).all():
            break
    return label


def _earlier(lists: pa.ChunkedArray, leaf: int) -> list[np.ndarray]:
    """Who holds which earlier leaf that several rows share, a few thousand leaves at a time."""
    lists = lists.combine_chunks()
    codes = lists.flatten().to_numpy()
    row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
    before = codes < leaf
    found, place, often = np.unique(codes[before], return_inverse=True, return_counts=True)
    shared = often[place] > 1
    column = np.cumsum(often > 1) - 1
    row, place = row[before][shared], column[place[shared]]
    out = []
    for at in range(0, int((often > 1).sum()), 4096):
        held = np.zeros((len(lists), min(4096, int((often > 1).sum()) - at)), np.float32)
        here = (place >= at) & (place < at + 4096)
        held[row[here], place[here] - at] = 1
        out.append(held)
    return out


def _compared(dtype: str, width: int, cosine: float):
    """Counts and links of one pair of blocks of a leaf."""

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("node")
        leaf, i, j = (group[c][0].as_py() for c in ("leaf", "i", "j"))
        x = _unit(_read(group["vector"], dtype, width))
        copies = group["copies"].to_numpy()
        own = group["own"].to_numpy()
        earlier = _earlier(group["leaves"], leaf)
        links = np.zeros(len(x), np.int64)
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        ends_a, ends_b = [], []
        for at in range(0, len(left), 512):
            rows = left[at : at + 512]
            near = x[rows] @ x[right].T >= cosine
            if i == j:
                near &= rows[:, None] < right[None, :]
            if near.any():
                for held in earlier:
                    near &= held[rows] @ held[right].T == 0
            a, b = np.nonzero(near)
            a, b = rows[a], right[b]
            links += np.bincount(a, weights=copies[b], minlength=len(x)).astype(np.int64)
            links += np.bincount(b, weights=copies[a], minlength=len(x)).astype(np.int64)
            ends_a.append(a)
            ends_b.append(b)
        none = np.zeros(0, np.int64)
        label = _classes(len(x), np.concatenate([none, *ends_a]), np.concatenate([none, *ends_b]))
        some = np.flatnonzero(links > 0)
        return pa.table(
            {
                "node": group["node"].take(pa.array(some)),
                "other": group["node"].take(pa.array(label[some])),
                "links": pa.array(links[some]),
            }
        )

    return run


def cosine_classes(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    cosine: float = COSINE,
    trees: int = TREES,
    sample: int = SAMPLE,
    leaf_rows: int = LEAF,
    block: int = BLOCK,
    seed: int = 5,
) -> DataFrame:
    """vec_id, n_links, component_id and kept of every vector."""
    rows = picked(vectors, vec_id=id_col, vector=vector_col)
    kind = rows.schema["vec_id"].dataType.simpleString()
    dtype = "<f4" if rows.schema["vector"].dataType.elementType.simpleString() == "float" else "<f8"
    width = max(rows.agg(F.max(F.size("vector"))).first()[0] or 1, 1)
    margin = SPILL * float(np.sqrt(2 - 2 * cosine))
    named = stored(rows.mapInArrow(_named(width), f"vec_id {kind}, node binary, vector binary"))
    nodes = named.where("node IS NOT NULL").groupBy("node")
    nodes = stored(nodes.agg(F.any_value("vector").alias("vector"), F.count("*").alias("copies")))
    count = nodes.count()
    place = F.shiftrightunsigned(F.xxhash64("node"), 11) / F.lit(float(1 << 53))
    few = nodes.where(place < F.lit(sample / max(count, 1))).orderBy("node").select("vector").toArrow()
    x = _unit(_read(few["vector"], dtype, width))
    rng = np.random.default_rng(seed)
    forest = [grow(x, rng, margin, LEAF_SAMPLE) for _ in range(trees)]
    placed = stored(
        nodes.select("node", "vector").mapInArrow(
            _placed(forest, dtype, width, margin), "node binary, leaf bigint"
        )
    )
    placed = _refined(placed, nodes, dtype, width, margin, leaf_rows)
    blocks = F.ceil(F.count("*") / F.lit(block)).cast("int").alias("blocks")
    sizes = stored(
        placed.groupBy(F.col("leaf").alias("of")).agg(F.count("*").alias("members"), blocks).where("members > 1")
    )
    lists = placed.groupBy(F.col("node").alias("name")).agg(F.sort_array(F.collect_set("leaf")).alias("leaves"))
    carried = nodes.join(lists, F.col("node") == F.col("name")).drop("name")
    carried = carried.withColumn("leaf", F.explode("leaves"))
    carried = carried.join(sizes, F.col("leaf") == F.col("of"))
    carried = carried.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    carried = carried.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    carried = carried.select(
        "leaf", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
        "own", "node", "copies", "vector", "leaves",
    )
    met = stored(
        carried.groupBy("leaf", "i", "j").applyInArrow(
            _compared(dtype, width, cosine), "node binary, other binary, links bigint"
        )
    )
    linked = met.groupBy(F.col("node").alias("n1")).agg(F.sum("links").alias("links"))
    classes = components(met.select(F.col("node").alias("a"), F.col("other").alias("b")))
    classes = classes.select(F.col("node").alias("n2"), "root")
    known = nodes.select("node", "copies").join(linked, F.col("node") == F.col("n1"), "left")
    known = known.join(classes, F.col("node") == F.col("n2"), "left")
    known = stored(
        known.select(
            F.col("node").alias("of"),
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("root", "node").alias("class"),
        )
    )
    joined = named.select("vec_id", "node").join(known, F.col("node") == F.col("of"), "left")
    joined = stored(joined.select("vec_id", "n_links", "class"))
    least = joined.where("class IS NOT NULL").groupBy(F.col("class").alias("of"))
    least = stored(least.agg(F.min("vec_id").alias("least")))
    out = joined.join(least, F.col("class") == F.col("of"), "left")
    component = F.when(F.col("class").isNull(), F.col("vec_id")).otherwise(F.col("least"))
    return out.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.col("class").isNull()).alias("kept"),
    )
