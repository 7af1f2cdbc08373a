"""Importance resampling towards a target set: hashed word features, one exact gain per bucket.

A feature is a run of one or more neighbouring words joined by one space; its bucket is its CRC-32 modulo
the number of buckets. Texts have a head and a tail. The head is the most frequent words of all texts, at
most ``HEAD`` of 64 bytes each, counted exactly and sent to all tasks with the CRC state in which each leaves
the register; for longer runs also at most ``HEAD_PAIRS`` frequent pairs of head words with their buckets.
Words and pairs outside of the head take a direct CRC; a longer run goes on from the state of its first
words, since CRC is linear and the state after more bytes is a shift and an addition. Head and tail give
the same values, so the totals of the buckets are exact whatever the head holds; it only saves work.

Three scans: words for the head, bucket totals of documents and targets, and weights of documents. Only the
head and one gain per bucket are sent to tasks. Draws take the highest sums of weight and Gumbel noise,
which is a hash of the id; ranks come from a range-partitioned order and the sizes of its partitions.

Defined cases: a null or empty text has no features and weight 0; a null id draws its noise as the text
``null``; rows that repeat are scored and ranked one by one, in any order among rows with the same score and
id; without documents that are long enough nothing is drawn; an empty target table counts as zero
everywhere; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import words
from .common import picked, stored, takes_rows
from .vocabulary import coded

BUCKETS = 10_000
LEAST_WORDS = 20
PERCENT = 10
SEED = 2024
HEAD = 65_536
HEAD_PAIRS = 262_144
HEAD_BYTES = 64

_POLYNOMIAL = 0xEDB88320


def _bytewise() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(_POLYNOMIAL), table >> 1)
    return table


def _through(tables: np.ndarray, register: np.ndarray) -> np.ndarray:
    out = np.zeros_like(register)
    for k in range(4):
        out ^= tables[k][(register >> np.uint32(8 * k)) & np.uint32(255)]
    return out


@cache
def _shifts() -> list[np.ndarray]:
    """For each k, what 2**k zero bytes make of each byte of the register."""
    byte = _bytewise()
    unit = [np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)]
    level = np.stack([(u >> np.uint32(8)) ^ byte[u & np.uint32(255)] for u in unit])
    found = [level]
    for _ in range(40):
        level = np.stack([_through(level, row) for row in level])
        found.append(level)
    return found


def joined(first: np.ndarray, second: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC of each first text followed by a second one of ``size`` bytes, from the CRC of both."""
    out = first.astype(np.uint32)
    left = size.astype(np.int64)
    for k in range(int(left.max(initial=0)).bit_length()):
        at = (left >> k) & 1 == 1
        out[at] = _through(_shifts()[k], out[at])
    return out ^ second


class Head:
    """The frequent words with their states, and frequent pairs of them with their buckets."""

    def __init__(self, known: list[str]) -> None:
        self.words = pa.array(known, pa.string())
        self.state = np.array([zlib.crc32(w.encode()) for w in known], np.uint32)
        self.pairs = np.zeros(0, np.int64)
        self.pair_state = np.zeros(0, np.uint32)

    def add_pairs(self, keys: list[int]) -> None:
        self.pairs = np.array(sorted(keys), np.int64)
        a, b = self.pairs >> 32, self.pairs & 0xFFFFFFFF
        size = pc.binary_length(self.words).to_numpy(zero_copy_only=False)
        self.pair_state = extended(self.state[a], self.state[b], size[b])

    def codes(self, known: pa.Array) -> np.ndarray:
        """The place of each word in the head, -1 for the tail."""
        found = pc.index_in(known, value_set=self.words)
        return pc.fill_null(found, -1).to_numpy(zero_copy_only=False).astype(np.int64)


_BLANK = np.uint32(zlib.crc32(b" "))


def extended(state: np.ndarray, word: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The state after one blank and a word."""
    return joined(state, joined(np.broadcast_to(_BLANK, word.shape), word, size), size + 1)


def _slices(batches: Iterator[pa.RecordBatch]):
    for batch in takes_rows(batches):
        offsets, data = words.utf8(batch.column("text"))
        for low, high in words.slices(offsets):
            own = offsets[low : high + 1] - offsets[low]
            text = words.LOWER[data[offsets[low] : offsets[high]]]
            owner, start, end = words.find(text, own, words.ALPHANUMERIC)
            codes, known = coded(text, words.ALPHANUMERIC, start, end)
            yield batch.slice(low, high - low), owner, codes, known.cast(pa.string()), end - start


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, _, codes, known, _ in _slices(batches):
        n = np.bincount(codes, minlength=len(known)).astype(np.int64)
        short = pc.less_equal(pc.binary_length(known), HEAD_BYTES)
        yield pa.RecordBatch.from_arrays([known, pa.array(n)], ["word", "n"]).filter(short)


def _pair_counts(head: Head):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, owner, codes, known, _ in _slices(batches):
            place = head.codes(known)[codes]
            near = (owner[1:] == owner[:-1]) & (place[1:] >= 0) & (place[:-1] >= 0)
            keys, n = np.unique((place[:-1] << 32 | place[1:])[near], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n.astype(np.int64))], ["pair", "n"])

    return run


def _frequent(counted: DataFrame, most: int) -> DataFrame:
    """The rows of the highest classes of n that are ``most`` rows at most together.

    Classes are quarters of powers of two, so there are at most 256, however many rows there are.
    """
    height = F.floor(F.log2("n") * 4)
    kept, from_height = 0, None
    for row in counted.groupBy(height.alias("height")).count().orderBy(F.desc("height")).collect():
        kept += row["count"]
        if kept > most:
            break
        from_height = row["height"]
    return counted.where(height >= from_height) if from_height is not None else counted.where("false")


def head_of(texts: DataFrame, longest: int = 1) -> Head:
    """The head of all texts; what reaches the driver is bounded by HEAD and HEAD_PAIRS rows."""
    counted = texts.mapInArrow(_word_counts, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    head = Head(sorted(r["word"] for r in _frequent(stored(counted), HEAD).select("word").collect()))
    if longest > 1:
        pairs = texts.mapInArrow(_pair_counts(head), "pair bigint, n bigint")
        pairs = stored(pairs.groupBy("pair").agg(F.sum("n").alias("n")))
        head.add_pairs([r["pair"] for r in _frequent(pairs, HEAD_PAIRS).select("pair").collect()])
    return head


def features(owner, codes, known: pa.Array, size, head: Head, longest: int):
    """Owner and CRC of every run, run length by run length."""
    place = head.codes(known)
    state = np.zeros(len(known), np.uint32)
    state[place >= 0] = head.state[place[place >= 0]]
    tail = np.flatnonzero(place < 0)
    state[tail] = [zlib.crc32(w.encode()) for w in known.take(pa.array(tail)).to_pylist()]
    word, place = state[codes], place[codes]
    run = word
    yield owner, run
    for k in range(1, longest):
        whole = owner[k:] == owner[: len(owner) - k]
        after = np.zeros(len(owner), np.uint32)
        at = np.flatnonzero(whole)
        if k == 1 and len(head.pairs):
            key = np.where((place[at] >= 0) & (place[at + 1] >= 0), place[at] << 32 | place[at + 1], -1)
            found = np.minimum(np.searchsorted(head.pairs, key), len(head.pairs) - 1)
            hit = head.pairs[found] == key
            after[at[hit]] = head.pair_state[found[hit]]
            at = at[~hit]
        after[at] = extended(run[at], word[at + k], size[at + k])
        run = after
        at = np.flatnonzero(whole)
        yield owner[at], run[at]


def _totals(head: Head, buckets: int, longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for _, owner, codes, known, size in _slices(batches):
            for _, crc in features(owner, codes, known, size, head, longest):
                total += np.bincount(crc % np.uint32(buckets), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    return run


def gains(docs: DataFrame, targets: DataFrame, head: Head, buckets: int, longest: int) -> DataFrame:
    """(bucket, s, t, gain) for every bucket, from the features of all documents and targets."""
    count = _totals(head, buckets, longest)
    seen = docs.mapInArrow(count, "bucket bigint, n bigint").select("bucket", F.col("n").alias("s"), F.lit(0).cast("bigint").alias("t"))
    wanted = targets.mapInArrow(count, "bucket bigint, n bigint").select("bucket", F.lit(0).cast("bigint").alias("s"), F.col("n").alias("t"))
    none = docs.sparkSession.range(buckets).select(F.col("id").alias("bucket"), F.lit(0).cast("bigint").alias("s"), F.lit(0).cast("bigint").alias("t"))
    each = stored(seen.union(wanted).union(none).groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")))
    whole = each.agg(F.sum("s").cast("double").alias("s_all"), F.sum("t").cast("double").alias("t_all")).first()
    more = lambda c, plus: F.col(c).cast("double") + F.lit(float(plus))
    ratio = more("t", 1) * F.lit(whole["s_all"] + buckets) / (more("s", 1) * F.lit(whole["t_all"] + buckets))
    return each.select("bucket", "s", "t", F.floor(1000 * F.log(ratio)).alias("gain"))


def _weights(head: Head, gain: np.ndarray, longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, owner, codes, known, size in _slices(batches):
            n = rows.num_rows
            count, weight = np.zeros(n, np.int64), np.zeros(n, np.int64)
            n_words = np.bincount(owner, minlength=n).astype(np.int64)
            for own, crc in features(owner, codes, known, size, head, longest):
                count += np.bincount(own, minlength=n)
                np.add.at(weight, own, gain[crc % np.uint32(len(gain))])
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), pa.array(n_words), pa.array(count), pa.array(weight)],
                ["doc_id", "n_words", "n_features", "weight"],
            )

    return run


def _ranked(rows: DataFrame) -> DataFrame:
    """``rank`` from 1 by score descending, then id, without a task that holds all rows.

    Rows are sorted over range partitions and stored with their partition and place there; ranks are that
    place plus the rows of earlier partitions.
    """
    order = rows.orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    place = F.monotonically_increasing_id()
    held = stored(order.select("*", F.shiftright(place, 33).alias("part"), place.bitwiseAND((1 << 33) - 1).alias("at")))
    parts = held.groupBy("part").agg(F.count("*").alias("size"))
    before = F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    # One row per partition of the sort.
    parts = parts.select("part", F.coalesce(before, F.lit(0)).alias("before"))
    return held.join(parts, "part").withColumn("rank", F.col("before") + F.col("at") + 1).drop("part", "at", "before")


def importance(
    docs: DataFrame,
    targets: DataFrame,
    longest: int = 1,
    buckets: int = BUCKETS,
    least_words: int = LEAST_WORDS,
    percent: int = PERCENT,
    seed: int = SEED,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_text: str = "text",
) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every document; rank is null where it isn't drawn."""
    texts = picked(docs, doc_id=id_col, text=text_col)
    aims = picked(targets, text=target_text)
    head = head_of(texts.select("text").union(aims), longest)
    table = gains(texts.select("text"), aims, head, buckets, longest)
    gain = np.zeros(buckets, np.int64)
    for row in table.select("bucket", "gain").collect():  # one row per bucket
        gain[row["bucket"]] = row["gain"]
    kind = texts.schema["doc_id"].dataType.simpleString()
    weighed = texts.mapInArrow(
        _weights(head, gain, longest), f"doc_id {kind}, n_words bigint, n_features bigint, weight bigint"
    )
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    scored = stored(weighed.withColumn("score", F.col("weight") + noise))
    long_enough = scored.where(F.col("n_words") >= least_words)
    drawn = percent * long_enough.count() // 100
    names = ["doc_id", "n_features", "weight", "score"]
    ranked = _ranked(long_enough.select(*names))
    ranked = ranked.select(*names, F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank"))
    short = scored.where(F.col("n_words") < least_words).select(*names, F.lit(None).cast("bigint").alias("rank"))
    return ranked.union(short)


def resampled(docs: DataFrame, targets: DataFrame, **options) -> DataFrame:
    """The drawn documents with all their columns; rows that repeat a drawn id come along."""
    id_col = options.get("id_col", "doc_id")
    drawn = importance(docs, targets, **options).where("rank IS NOT NULL")
    ids = drawn.select(F.col("doc_id").alias(id_col)).distinct()
    return docs.join(ids, id_col, "left_semi")
