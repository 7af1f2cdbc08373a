"""Phrases of up to four words that hold together, from a weighted de Bruijn graph of word grams.

The longest grams are the edges: an edge of four words leads from the node of its first three to the node
of its last three and weighs as often as it occurs. Where a piece of text ends, fewer words follow; such a
shorter gram is the correction of a piece end. Each word of the corpus begins exactly one edge or
correction, so one count of those tells all shorter phrases: a node occurs as often as what flows out of
it plus the corrections that are the node itself, and the same step leads on to pairs and words.

Edges that weigh enough are compacted: a node with one edge in and one of the same weight out is inside a
path, and a path is stored once with its weight. Chains are followed by doubling, so the rounds grow with
the logarithm of the longest one; a path row holds at most ``PATH`` edges, a longer path has several rows.

A phrase cannot be frequent when two of its neighbouring words are a rare pair. Counters of hashed pairs
(2**``CELL_BITS`` of them, whatever the input) tell pairs that are surely rare, and these end a piece like a full
stop does: no count of a frequent phrase changes, since none holds such a pair. A counter that several
pairs share may keep a rare pair, never lose a frequent one.

Defined cases: a null or empty text has no words; a null language is ``und``; a null id counts like any
other, and rows that repeat count each time; an empty table has no phrases; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import words
from .common import partitions, picked, stored, takes_rows
from .vocabulary import coded

LONGEST = 4
LEAST_COUNT = 30
TOP = 2000
SCALE = 2_000_000
#: A phrase goes when a longer one has at least CONTAINED percent of its occurrences.
CONTAINED = 80
#: Counters of pairs are 2**CELL_BITS, dealt out in segments of 2**SEGMENT_BITS.
CELL_BITS = 28
SEGMENT_BITS = 16
FLUSH = 2_000_000
PATH = 1000
SHARES = 16

#: Pieces end at . , ; : ! ? and at line feed to carriage return.
BREAK = np.zeros(256, dtype=bool)
BREAK[[ord(c) for c in ".,;:!?\n\v\f\r"]] = True
WORD = ~BREAK
WORD[[32, 9]] = False

_MANY = 255


def _slices(batches: Iterator[pa.RecordBatch]):
    """Languages, bytes in lower case and words of slices of about one MB.

    ``same`` tells whether word k + 1 continues the piece of word k.
    """
    for batch in takes_rows(batches):
        offsets, data = words.utf8(batch.column("text"))
        for low, high in words.slices(offsets):
            lang = batch.column("lang").slice(low, high - low).dictionary_encode()
            names = lang.dictionary.to_pylist()
            own = offsets[low : high + 1] - offsets[low]
            text = words.LOWER[data[offsets[low] : offsets[high]]]
            owner, start, end = words.find(text, own, WORD)
            if not len(start):
                continue
            spoken = lang.indices.to_numpy(zero_copy_only=False).astype(np.int64)[owner]
            breaks = np.cumsum(BREAK[text])[start]
            same = np.zeros(len(start), bool)
            same[:-1] = (owner[1:] == owner[:-1]) & (breaks[1:] == breaks[:-1])
            yield names, spoken, text, start, end, same


def _cells(names, spoken, text, start, end, cell_bits: int) -> np.ndarray:
    """The counter of the pair that each word but the last begins."""
    tongues = pa.array(names, pa.string())
    at, letters = words.utf8(tongues)
    tongue = words.hashes(letters, at[:-1], at[1:])[spoken]
    word = words.hashes(text, start, end)
    return (words.together(tongue[:-1], word[:-1], word[1:]) >> np.uint64(64 - cell_bits)).astype(np.uint32)


def _flushed(kept: list[np.ndarray]) -> pa.RecordBatch:
    cells, count = np.unique(np.concatenate(kept), return_counts=True)
    count = np.minimum(count, _MANY).astype(np.uint8)
    segment = cells >> SEGMENT_BITS
    first = np.flatnonzero(np.diff(segment, prepend=np.uint32(0xFFFFFFFF)))
    last = np.append(first[1:], len(cells))
    within = (cells & np.uint32((1 << SEGMENT_BITS) - 1)).astype("<u2")
    return pa.RecordBatch.from_arrays(
        [
            pa.array(segment[first].astype(np.int32)),
            pa.array([within[a:b].tobytes() for a, b in zip(first, last, strict=True)], pa.binary()),
            pa.array([count[a:b].tobytes() for a, b in zip(first, last, strict=True)], pa.binary()),
        ],
        ["segment", "cells", "counts"],
    )


def _pair_counts(cell_bits: int, flush: int):
    """Counts of cells, some ``flush`` pairs together, one row for each segment they touch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = []
        size = 0
        for names, spoken, text, start, end, same in _slices(batches):
            kept.append(_cells(names, spoken, text, start, end, cell_bits)[same[:-1]])
            size += len(kept[-1])
            if size >= flush:
                yield _flushed(kept)
                kept, size = [], 0
        if size:
            yield _flushed(kept)

    return run


def _summed(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in takes_rows(batches):
            for segment, cells, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if segment not in total:
                    total[segment] = np.zeros(1 << SEGMENT_BITS, np.uint8)
                own, at = total[segment], np.frombuffer(cells, "<u2")
                more = np.frombuffer(counts, np.uint8)
                own[at] = np.minimum(own[at].astype(np.uint16) + more, _MANY)
        for segment, own in total.items():
            bits = np.packbits(own >= least).tobytes()
            yield pa.RecordBatch.from_arrays(
                [pa.array([segment], pa.int32()), pa.array([bits], pa.binary())], ["segment", "bits"]
            )

    return run


def pair_filter(
    rows: DataFrame, least: int, cell_bits: int = CELL_BITS, flush: int = FLUSH
) -> np.ndarray:
    """One bit for each counter: may a pair that it counts occur ``least`` times? 2**cell_bits / 8 bytes."""
    spark = rows.sparkSession
    counts = rows.mapInArrow(_pair_counts(cell_bits, flush), "segment int, cells binary, counts binary")
    dealt = counts.repartition(max(partitions(spark), 1), "segment")
    # A counter stops at 255, so larger limits use it as far as it goes.
    summed = dealt.mapInArrow(_summed(min(least, _MANY)), "segment int, bits binary")
    bits = np.zeros((1 << cell_bits) // 8, np.uint8)
    width = (1 << SEGMENT_BITS) // 8
    for row in summed.collect():  # 2**(cell_bits - SEGMENT_BITS) rows of 8 KB at most
        bits[row["segment"] * width : (row["segment"] + 1) * width] = np.frombuffer(row["bits"], np.uint8)
    return bits


def _begun(bits, cell_bits: int):
    """Grams that begin at each word and reach to the fourth word, the piece's end or a rare pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filter_ = bits.value
        for names, spoken, text, start, end, same in _slices(batches):
            cell = _cells(names, spoken, text, start, end, cell_bits)
            kept = (filter_[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1
            joined = same.copy()
            joined[:-1] &= kept.astype(bool)
            codes, known = coded(text, WORD, start, end)
            reach = np.ones(len(codes), np.int64)
            going = np.ones(len(codes), bool)
            for k in range(LONGEST - 1):
                going[: len(codes) - k] &= joined[k:]
                going[len(codes) - k :] = False
                reach += going
            known = known.cast(pa.string())
            tongues = pa.array(names, pa.string())
            for size in range(1, LONGEST + 1):
                at = np.flatnonzero(reach == size)
                if not len(at):
                    continue
                key = spoken[at] * len(known) + codes[at]
                for k in range(1, size):
                    _, key = np.unique(key, return_inverse=True)
                    key = key * len(known) + codes[at + k]
                _, first, count = np.unique(key, return_index=True, return_counts=True)
                at = at[first]
                parts = [known.take(pa.array(codes[at + k])) for k in range(size)]
                gram = pc.binary_join_element_wise(*parts, " ") if size > 1 else parts[0]
                yield pa.RecordBatch.from_arrays(
                    [
                        tongues.take(pa.array(spoken[at])),
                        gram,
                        pa.array(np.full(len(at), size, np.int32)),
                        pa.array(count.astype(np.int64)),
                    ],
                    ["lang", "gram", "size", "n"],
                )

    return run


def edges(
    docs: DataFrame,
    least: int = LEAST_COUNT,
    text_col: str = "text",
    lang_col: str = "lang",
    cell_bits: int = CELL_BITS,
    flush: int = FLUSH,
) -> DataFrame:
    """(lang, gram, size, n): edges of four words and the shorter corrections, counted."""
    rows = picked(docs, lang=lang_col, text=text_col)
    rows = rows.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text")
    bits = docs.sparkSession.sparkContext.broadcast(pair_filter(rows, least, cell_bits, flush))
    begun = rows.mapInArrow(_begun(bits, cell_bits), "lang string, gram string, size int, n bigint")
    return stored(begun.groupBy("lang", "gram", "size").agg(F.sum("n").alias("n")))


def _heads(linked: DataFrame) -> DataFrame:
    """(lang, gram, head, far) of edges with an edge ``before`` them: the chain's first edge and its distance.

    Pointers double each round. Edges on a ring without an entry never reach a first edge; they are what
    is left when a round brings no edge nearer to its end, and each of them stays its own path.
    """
    first = linked.select("lang", F.col("before").alias("gram")).distinct()
    first = first.join(linked.select("lang", "gram"), ["lang", "gram"], "left_anti")
    now = stored(
        linked.select("lang", "gram", F.col("before").alias("head"), F.lit(1).cast("bigint").alias("far")).union(
            first.select("lang", "gram", F.col("gram").alias("head"), F.lit(0).cast("bigint").alias("far"))
        )
    )
    open_before = None
    while True:
        up = now.select(
            F.col("lang").alias("up_lang"), F.col("gram").alias("up"),
            F.col("head").alias("up_head"), F.col("far").alias("up_far"),
        )
        step = now.join(up, (F.col("lang") == F.col("up_lang")) & (F.col("head") == F.col("up")))
        now = stored(
            step.select(
                "lang", "gram", F.col("up_head").alias("head"), (F.col("far") + F.col("up_far")).alias("far"),
                (F.col("up_far") > 0).alias("moved"),
            )
        )
        open_now = now.where("moved").count()
        if open_now == 0:
            return now.drop("moved")
        if open_now == open_before:
            return now.select(
                "lang", "gram", F.when(F.col("moved"), F.col("gram")).otherwise(F.col("head")).alias("head"),
                F.when(F.col("moved"), F.lit(0).cast("bigint")).otherwise(F.col("far")).alias("far"),
            )
        open_before = open_now
        now = now.drop("moved")


def _first(n: int):
    return F.substring_index("gram", " ", n)


def _last(n: int):
    return F.substring_index("gram", " ", -n)


def paths(grams: DataFrame, least: int = LEAST_COUNT) -> DataFrame:
    """(lang, words, n): the edges of weight ``least`` or more, unary paths compacted to rows of words."""
    heavy = stored(grams.where((F.col("size") == LONGEST) & (F.col("n") >= least)).drop("size"))
    gone = heavy.select("lang", _first(LONGEST - 1).alias("node"), F.col("gram").alias("after"), F.col("n").alias("out"))
    come = heavy.select("lang", _last(LONGEST - 1).alias("node"), F.col("gram").alias("before"), F.col("n").alias("into"))
    one = lambda df, *names: df.groupBy("lang", "node").agg(
        F.count("*").alias("degree"), *[F.min(c).alias(c) for c in names]
    ).where("degree = 1").drop("degree")
    links = one(gone, "after", "out").join(one(come, "before", "into"), ["lang", "node"])
    links = links.where("out = into AND before <> after")
    linked = stored(links.select("lang", F.col("after").alias("gram"), "before"))
    if linked.isEmpty():
        chained = heavy.select("*", F.col("gram").alias("head"), F.lit(0).cast("bigint").alias("far"))
    else:
        found = heavy.join(_heads(linked), ["lang", "gram"], "left")
        chained = found.select(
            "lang", "gram", "n", F.coalesce("head", "gram").alias("head"),
            F.coalesce("far", F.lit(0).cast("bigint")).alias("far"),
        )
    part = F.floor(F.col("far") / PATH).alias("part")
    row = F.array_sort(F.collect_list(F.struct("far", "gram"))).alias("row")
    grouped = chained.groupBy("lang", "head", part).agg(row, F.max("n").alias("n"))
    begin = F.split(F.col("row")[0]["gram"], " ")
    rest = F.transform(
        F.slice("row", 2, F.size("row")), lambda e: F.substring_index(e["gram"], " ", -1)
    )
    return grouped.select("lang", F.concat(begin, rest).alias("words"), "n")


def _runs(words_, size: int):
    """All phrases of ``size`` neighbouring words of an array."""
    places = F.sequence(F.lit(1), F.size(words_) - size + 1)
    return F.transform(places, lambda k: F.array_join(F.slice(words_, k, size), " "))


def counts(grams: DataFrame, routes: DataFrame, least: int = LEAST_COUNT) -> DataFrame:
    """(lang, size, phrase, n) of all phrases with at least ``least`` occurrences."""
    found = []
    flow = grams.select("lang", "gram", "size", "n")
    for size in range(LONGEST - 1, 0, -1):
        begun = flow.where(F.col("size") > size) if size == LONGEST - 1 else above
        ends = grams.where(F.col("size") == size).select("lang", "gram", "n")
        both = begun.select("lang", _first(size).alias("gram"), "n").union(ends)
        above = both.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
        if size > 1:
            above = stored(above)
        found.append(above.where(F.col("n") >= least).select("lang", F.lit(size).alias("size"), F.col("gram").alias("phrase"), "n"))
    longest = routes.select("lang", F.explode(_runs(F.col("words"), LONGEST)).alias("phrase"), "n")
    # A path that comes back to itself would hold an edge twice, but paths are made of distinct edges.
    out = longest.select("lang", F.lit(LONGEST).alias("size"), "phrase", "n")
    for df in found:
        out = out.union(df)
    return stored(out)


def _contained(routes: DataFrame, phrases: DataFrame) -> DataFrame:
    """(lang, phrase, longer): the most occurrences of a longer candidate that a phrase lies in."""
    inside = phrases.where(F.col("size") == 3).select(
        "lang", F.explode(_runs(F.split("phrase", " "), 2)).alias("phrase"), "n"
    )
    for size in (2, 3):
        inside = inside.union(
            routes.select("lang", F.explode(_runs(F.col("words"), size)).alias("phrase"), "n")
        )
    return inside.groupBy("lang", "phrase").agg(F.max("n").alias("longer"))


def collocations(
    docs: DataFrame,
    least: int = LEAST_COUNT,
    top: int = TOP,
    text_col: str = "text",
    lang_col: str = "lang",
    cell_bits: int = CELL_BITS,
    flush: int = FLUSH,
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the best phrases of each language."""
    grams = edges(docs, least, text_col, lang_col, cell_bits, flush)
    routes = stored(paths(grams, least))
    phrases = counts(grams, routes, least)
    cuts = phrases.where("size > 1").select(
        "lang", "phrase", "size", F.col("n").alias("a"),
        F.explode(F.expr("sequence(1, size - 1)")).alias("k"),
    )
    cuts = cuts.select(
        "lang", "phrase", "a", "k",
        F.expr("substring_index(phrase, ' ', k)").alias("head"),
        F.expr("substring_index(phrase, ' ', k - size)").alias("tail"),
    )
    known = phrases.select("lang", "phrase", "n")
    left = known.select("lang", F.col("phrase").alias("head"), F.col("n").alias("l"))
    right = known.select("lang", F.col("phrase").alias("tail"), F.col("n").alias("r"))
    cuts = cuts.join(left, ["lang", "head"]).join(right, ["lang", "tail"])
    # Decimals hold the product where 64 bits would not; the quotient is at most half of SCALE.
    exact = F.expr(f"cast({SCALE} as decimal(10,0)) * cast(a as decimal(20,0)) div cast(l + r as decimal(20,0))")
    lowest = F.min(F.struct(exact.alias("score"), "k", "l", "r")).alias("cut")
    scored = cuts.groupBy("lang", "phrase", "a").agg(lowest)
    scored = scored.join(_contained(routes, phrases), ["lang", "phrase"], "left")
    scored = scored.where("longer IS NULL OR 100 * longer < %d * a" % CONTAINED)
    order = (F.desc("score"), F.desc("a"), "phrase")
    flat = scored.select("lang", "phrase", "a", "cut.l", "cut.r", F.col("cut.score").cast("bigint").alias("score"))
    # The best of each share first, so that a language's task gets SHARES * top rows at most.
    share = F.pmod(F.xxhash64("phrase"), F.lit(SHARES)).alias("share")
    some = Window.partitionBy("lang", "share").orderBy(*order)
    few = flat.select("*", share).withColumn("rank", F.row_number().over(some)).where(F.col("rank") <= top)
    best = Window.partitionBy("lang").orderBy(*order)
    ranked = few.drop("share").withColumn("rank", F.row_number().over(best).cast("bigint")).where(F.col("rank") <= top)
    total = grams.groupBy("lang").agg(F.sum("n").alias("n"))
    return ranked.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
