"""Near-duplicate documents by one-permutation hashing.

1. Each text becomes the set of hashes of its word shingles. Documents with equal sets share a node,
   named by a 128-bit digest of the set, so copies cost one row each and no pair.
2. One hash per shingle feeds all bins of a signature; empty bins borrow from others in an order that
   depends on the bin alone (optimal densification). Bands of a signature make bucket keys.
3. In each bucket every node meets only the smallest one. These stars, where the signatures agree for
   about half, connect nodes into coarse groups; they bound pairs to one per node and band.
4. Coarse groups are settled on full sets. A group is cut into blocks of ``BLOCK`` nodes and each pair of
   blocks is a task, so no task grows with a group. In a task the node with the most common shingles
   goes first; nodes already connected are not compared again, the others are compared by signature and,
   where it leaves a chance, exactly. A task returns at most one link per node.
5. Components of those links give the classes.

Defined cases: a text that is null or has no words has no shingles, links with nothing and is kept; one
with fewer words than a shingle is one shingle; equal rows share a class, and rows with a null id take
part without ever naming it; a class whose ids are all null has a null id and keeps one text; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .common import lean, picked, stored, takes_rows
from .components import components

BANDS = 24
ROWS = 5
BINS = BANDS * ROWS
SIMILARITY = (80, 100)
#: Agreement of signatures below which a star does not join a coarse group.
COARSE = 0.5
#: Agreement that full sets of at least ``SMALL`` shingles with the similarity wanted miss about once in
#: two million pairs (five standard deviations); smaller sets are always compared exactly.
LIKELY = 0.62
SMALL = 64
BLOCK = 2048

_probe_rows = np.random.default_rng(7).integers(0, BINS, (256, BINS))


def shingles(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text in ascending order, and how many each text has."""
    lowered = words.LOWER[data]
    owner, start, end = words.find(lowered, offsets, words.NOT_BLANK)
    h = words.hashes(lowered, start, end)
    count = np.bincount(owner, minlength=len(offsets) - 1)
    first = np.cumsum(count) - count
    n = len(h)
    if n >= size:
        value = words.together(*[h[k : n - size + 1 + k] for k in range(size)])
    else:
        value = np.zeros(0, np.uint64)
    sets = []
    for k, (at, c) in enumerate(zip(first.tolist(), count.tolist(), strict=True)):
        if c >= size:
            sets.append(np.unique(value[at : at + c - size + 1]))
        elif c:
            sets.append(words.together(*[h[at + j : at + j + 1] for j in range(c)]))
        else:
            sets.append(value[:0])
    each = np.array([len(s) for s in sets], np.int64)
    return (np.concatenate(sets) if sets else value[:0]), each


def signatures(values: np.ndarray, each: np.ndarray) -> np.ndarray:
    """Densified one-permutation signatures, a row of ``BINS`` 32-bit values for each nonempty set."""
    count = len(each)
    owner = np.repeat(np.arange(count), each)
    bins = ((values >> np.uint64(32)) * np.uint64(BINS)) >> np.uint64(32)
    slot = owner * BINS + bins.astype(np.int64)
    first = np.ones(len(slot), bool)
    first[1:] = slot[1:] != slot[:-1]  # values ascend, so the first of a bin is its least
    out = np.zeros(count * BINS, np.uint32)
    full = np.zeros(count * BINS, bool)
    out[slot[first]] = words.mixed(values[first]).astype(np.uint32)
    full[slot[first]] = True
    known = full.copy()
    empty = np.flatnonzero(~full & np.repeat(each > 0, BINS))
    for row in _probe_rows:
        if not len(empty):
            break
        there = empty - empty % BINS + row[empty % BINS]
        hit = known[there]
        out[empty[hit]] = out[there[hit]]
        empty = empty[~hit]
    step = 0
    while len(empty):  # hardly any set gets here; then the next full bin
        step += 1
        there = empty - empty % BINS + (empty % BINS + step) % BINS
        hit = known[there]
        out[empty[hit]] = out[there[hit]]
        empty = empty[~hit]
    return out.reshape(count, BINS)


def digests(values: np.ndarray, each: np.ndarray) -> list[bytes | None]:
    """16 bytes that name a set; None for the empty one."""
    some = each > 0
    at = (np.cumsum(each) - each)[some]
    halves = [
        np.add.reduceat(words.mixed(values + np.uint64(salt)), at) if len(at) else values[:0]
        for salt in (0x51ED270B, 0xA24BAED4963EE407)
    ]
    named = iter(np.stack(halves, 1).astype("<u8"))
    return [next(named).tobytes() if s else None for s in some]


def band_keys(signature: np.ndarray) -> np.ndarray:
    bands = signature.astype(np.uint64).reshape(len(signature), BANDS, ROWS)
    salt = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), bands.shape[:2])
    return words.together(salt, *[bands[:, :, k] for k in range(ROWS)]).view(np.int64)


def _sketched(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in takes_rows(batches):
            offsets, data = words.utf8(batch.column(2))
            for low, high in words.slices(offsets, words.SMALL_SLICE):
                own = offsets[low : high + 1] - offsets[low]
                values, each = shingles(data[offsets[low] : offsets[high]], own, size)
                rows = signatures(values, each)
                keys = band_keys(rows)
                some = each > 0
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(low, high - low),
                        batch.column(1).slice(low, high - low),
                        pa.array(each),
                        pa.array(digests(values, each), pa.binary()),
                        pa.array([k if s else None for k, s in zip(keys, some, strict=True)], pa.list_(pa.int64())),
                        pa.array(
                            [r.tobytes() if s else None for r, s in zip(rows.astype(np.uint8), some, strict=True)],
                            pa.binary(),
                        ),
                    ],
                    ["doc_id", "row_key", "n_shingles", "node", "bands", "signature"],
                )

    return run


def _sets(size: int):
    """Node and full set of texts; only rows whose text makes the node that was asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in takes_rows(batches):
            offsets, data = words.utf8(batch.column(0))
            wanted = batch.column(1).to_pylist()
            for low, high in words.slices(offsets, words.SMALL_SLICE):
                own = offsets[low : high + 1] - offsets[low]
                values, each = shingles(data[offsets[low] : offsets[high]], own, size)
                names = digests(values, each)
                cut = np.split(values, np.cumsum(each)[:-1])
                keep = [k for k in range(high - low) if names[k] == wanted[low + k]]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([names[k] for k in keep], pa.binary()),
                        batch.column(2).take(pa.array([low + k for k in keep], pa.int64())),
                        pa.array([cut[k].tobytes() for k in keep], pa.binary()),
                    ],
                    ["node", "root", "shingles"],
                )

    return run


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stars whose signatures agree enough."""
    for batch in takes_rows(batches):
        a, b = (
            np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, BINS) for k in (2, 3)
        )
        keep = pa.array((a == b).mean(1) >= COARSE)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"]
        )


def linked(values: np.ndarray, each: np.ndarray, similarity: tuple[int, int]) -> np.ndarray:
    """For each set the first set of its class, where classes are joined by every link among the sets.

    Sets are compared only across classes found so far; the set whose shingles are the most common
    goes first, which joins the copies of one original at once.
    """
    count = len(each)
    part, whole = similarity
    first = np.cumsum(each) - each
    _, place, often = np.unique(values, return_inverse=True, return_counts=True)
    common = np.add.reduceat(often[place], first) / each
    rows = signatures(values, each).astype(np.uint8)
    label = np.arange(count)
    for c in np.argsort(-common, kind="stable").tolist():
        size = each[c]
        other = label != label[c]
        other &= (whole * np.minimum(each, size) >= part * np.maximum(each, size))
        maybe = np.flatnonzero(other)
        if not len(maybe):
            continue
        near = (rows[maybe] == rows[c]).mean(1) >= LIKELY
        maybe = maybe[near | (each[maybe] < SMALL) | (size < SMALL)]
        if not len(maybe):
            continue
        own = values[first[c] : first[c] + size]
        flat = values[np.repeat(first[maybe], each[maybe]) + words.runs(each[maybe])]
        at = np.minimum(np.searchsorted(own, flat), size - 1)
        hit = (own[at] == flat).astype(np.int64)
        inter = np.add.reduceat(hit, np.cumsum(each[maybe]) - each[maybe])
        union = each[maybe] + size - inter
        for old in np.unique(label[maybe[whole * inter >= part * union]]).tolist():
            label[label == old] = label[c]
    return label


def _settled(similarity: tuple[int, int]):
    def run(group: pa.Table) -> pa.Table:
        pairs = dict(zip(group["node"].to_pylist(), group["shingles"].to_pylist(), strict=True))
        nodes = sorted(pairs)
        sets = [np.frombuffer(pairs[n], np.uint64) for n in nodes]
        label = linked(np.concatenate(sets), np.array([len(s) for s in sets], np.int64), similarity)
        head: dict[int, bytes] = {}
        for node, k in zip(nodes, label.tolist(), strict=True):
            head.setdefault(k, node)
        made = [(n, head[k]) for n, k in zip(nodes, label.tolist(), strict=True) if head[k] != n]
        return pa.table(
            {
                "a": pa.array([a for a, _ in made], pa.binary()),
                "b": pa.array([b for _, b in made], pa.binary()),
            }
        )

    return run


def _blocked(sets: DataFrame, block: int) -> DataFrame:
    """Each set once for every pair of blocks that its own block is in."""
    sizes = stored(sets.groupBy("root").agg(F.count("*").alias("members")))
    blocks = F.ceil(F.col("members") / F.lit(block)).cast("int")
    cut = sizes.select(F.col("root").alias("of"), blocks.alias("blocks"))
    rows = sets.join(cut, F.col("root") == F.col("of")).drop("of")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.select(
        "root", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "shingles"
    )


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 5,
    similarity: tuple[int, int] = SIMILARITY,
    block: int = BLOCK,
) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document; ``row_key`` names id and text."""
    texts = picked(docs, doc_id=id_col, text=text_col)
    kind = texts.schema["doc_id"].dataType.simpleString()
    texts = texts.select("doc_id", F.xxhash64("doc_id", "text").alias("row_key"), "text")
    rows = stored(
        texts.mapInArrow(
            lean(_sketched(shingle)),
            f"doc_id {kind}, row_key bigint, n_shingles bigint, node binary, bands array<bigint>, "
            "signature binary",
        )
    )
    named = rows.where("node IS NOT NULL")
    nodes = stored(
        named.groupBy("node").agg(
            F.min("row_key").alias("row_key"),
            F.any_value("bands").alias("bands"),
            F.any_value("signature").alias("signature"),
        )
    )
    bands = nodes.select("node", F.explode("bands").alias("band"))
    centres = stored(
        bands.groupBy("band").agg(F.min("node").alias("centre"), F.count("*").alias("n")).where("n > 1")
    )
    stars = bands.join(centres.select(F.col("band").alias("of"), "centre"), F.col("band") == F.col("of"))
    stars = stored(stars.where("node <> centre").select("node", "centre").distinct())
    mine = nodes.select(F.col("node").alias("n1"), F.col("signature").alias("s1"))
    theirs = nodes.select(F.col("node").alias("n2"), F.col("signature").alias("s2"))
    signed = stars.join(mine, F.col("node") == F.col("n1")).join(theirs, F.col("centre") == F.col("n2"))
    coarse = components(
        signed.select("node", "centre", "s1", "s2").mapInArrow(lean(_alike), "a binary, b binary")
    )
    asked = nodes.select(F.col("node").alias("wanted"), F.col("row_key").alias("key")).join(
        coarse, F.col("wanted") == F.col("node")
    )
    asked = stored(asked.select("key", "wanted", "root"))
    # What is asked for grows with the data, so it is never broadcast, however small it is.
    found = texts.select("row_key", "text").join(asked.hint("merge"), F.col("row_key") == F.col("key"))
    sets = stored(
        found.select("text", "wanted", "root").mapInArrow(
            lean(_sets(shingle)), "node binary, root binary, shingles binary"
        )
    )
    links = (
        _blocked(sets, block)
        .groupBy("root", "i", "j")
        .applyInArrow(_settled(similarity), "a binary, b binary")
    )
    classes = stored(components(links))
    joined = rows.select("doc_id", "row_key", "n_shingles", F.col("node").alias("own")).join(
        classes, F.col("own") == F.col("node"), "left"
    )
    joined = joined.withColumn("class", F.coalesce("root", "own")).drop("node", "root", "own")
    least = joined.where("class IS NOT NULL").groupBy("class")
    least = least.agg(F.min("doc_id").alias("least"), F.min("row_key").alias("first_key"))
    least = stored(least.withColumnRenamed("class", "of"))
    out = joined.join(least, F.col("class") == F.col("of"), "left")
    component = F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("least"))
    return out.select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(
            F.col("doc_id") == component, F.col("class").isNull() | (F.col("row_key") == F.col("first_key"))
        ).alias("kept"),
        "row_key",
    )


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One document of each class, with all its columns; equal rows count once."""
    classes = near_duplicates(docs, id_col, text_col, **options)
    kept = stored(classes.where("kept").select(F.col("row_key").alias("_kept")).distinct())
    rows = docs.withColumn("_own", F.xxhash64(id_col, text_col))
    rows = rows.join(kept, F.col("_own") == F.col("_kept"), "left_semi")
    return rows.dropDuplicates(["_own"]).drop("_own")
