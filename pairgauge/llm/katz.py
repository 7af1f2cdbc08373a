"""Language-model scores of whole documents: word bigrams with Katz backoff, learned from all training rows.

Model. P(v|u) = d(r) r / c(u) for a pair seen r times, else alpha(u) P(v); P(v) = d(r) r / N for a word seen
r times, else the mass that the discounts leave, for the one class of unknown words. d follows Good and
Turing up to ``K`` counts. alpha(u) is the mass left by the pairs of u over the mass that P gives to words
not seen after u, so every context sums to one exactly. A context whose pairs leave nothing counts one
more occurrence. The first word of a text follows a start sign; the end is a token.

Flow. Documents fall into blocks by a hash. A block knows its distinct words and pairs, so what it asks of
the count tables is pre-aggregated, and answers come back in the order of the question, without keys.

1. Blocks send words with their counts to word buckets: totals, numbers for words, answers.
2. Blocks send pairs of word numbers to buckets of the first word: totals, sums per context, answers.
3. Blocks score their documents from the answers.

Tables of counts are spread over buckets by the hash of the word or context. A context that occurs more than
``PIECE`` times is split by the hash of the second word into pieces of about that many pairs, each in a bucket of
its own; blocks ask all of its pieces for their sums and add them up, so no task grows with a frequent word or
with the start sign. Between steps only the histograms of small counts reach the driver.

Defined cases: a null or empty text is its end token; rows that repeat an id are scored one by one; rows with
a null id are learned from and scored; without training rows all words are unknown and a token has
probability one; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words
from .common import partitions, picked, stored, takes_rows

K = 5
BLOCK_BYTES = 16 << 20
PIECE = 1 << 19
LEVEL = 6
END = np.uint64(0xE0D0)
START_NUMBER = (1 << 31) - 1


# Arrays as compressed bytes: the first bytes of all values side by side, then the second ones, and so on.


def packed(values: np.ndarray) -> bytes:
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.dtype.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpacked(data: bytes, dtype) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    planes = planes.reshape(np.dtype(dtype).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(dtype).ravel()


# Discounts


def discounts(histogram: np.ndarray) -> np.ndarray:
    """d(0..K+1) from the numbers of items seen 0..K+1 times; the last entry holds for all beyond K.

    Where Good-Turing gives no discount between 0 and 1, half an occurrence is taken from each item.
    """
    n = histogram.astype(float)
    d = np.ones(K + 2)
    if n[1] > 0:
        rest = (K + 1) * n[K + 1] / n[1]
        r = np.arange(1, K + 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = (r + 1) * n[2 : K + 2] / (n[1 : K + 1] * r)
            d[1 : K + 1] = (ratio - rest) / (1 - rest)
    good = np.isfinite(d[1 : K + 1]) & (d[1 : K + 1] > 0) & (d[1 : K + 1] < 1) & (n[1] > 0)
    d[1 : K + 1] = np.where(good, d[1 : K + 1], 1 - 0.5 / np.arange(1, K + 1))
    return d


@dataclass(frozen=True)
class Words:
    """Sums over all training tokens and the unigram discounts."""

    tokens: int
    distinct: int
    discount: np.ndarray
    unknown: float

    @staticmethod
    def of(histogram: np.ndarray, tokens: int, distinct: int) -> Words:
        d = discounts(histogram)
        r = np.arange(K + 2)
        small = (r * histogram * (1 - d))[1 : K + 1].sum()
        return Words(tokens, distinct, d, small / tokens if tokens else 1.0)

    def chance(self, counts: np.ndarray) -> np.ndarray:
        """P of words by their counts; a word never seen has the whole unknown mass."""
        d = self.discount[np.minimum(counts, K + 1)]
        return np.where(counts > 0, d * counts / max(self.tokens, 1), self.unknown)


# Blocks


def _blobs(blocks: int):
    """Documents of a batch gathered by block, texts compressed together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=LEVEL)
        for batch in takes_rows(batches):
            block = batch.column(0).to_numpy()
            order = np.argsort(block, kind="stable")
            batch = batch.take(pa.array(order))
            block = block[order]
            offsets, data = words.utf8(batch.column(3))
            data = words.LOWER[data]
            at = np.append(np.flatnonzero(np.append(True, block[1:] != block[:-1])), len(block))
            for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([int(block[a])], pa.int32()),
                        pa.ListArray.from_arrays(pa.array([0, b - a], pa.int32()), batch.column(1).slice(a, b - a)),
                        pa.array([np.packbits(batch.column(2).slice(a, b - a).to_numpy(zero_copy_only=False)).tobytes()], pa.binary()),
                        pa.array([packed(np.diff(offsets[a : b + 1]).astype(np.int64))], pa.binary()),
                        pa.array([press.compress(data[offsets[a] : offsets[b]].tobytes())], pa.binary()),
                    ],
                    ["block", "doc_ids", "train", "sizes", "texts"],
                )

    return run


class Block:
    """Documents of a block as token numbers: places in ``lexicon``, the sorted hashes of its words."""

    def __init__(self, rows: pa.Table) -> None:
        unpress = zstandard.ZstdDecompressor()
        hashes, owners, train, count = [], [], [], 0
        for sizes, bits, texts in zip(
            rows["sizes"].to_pylist(), rows["train"].to_pylist(), rows["texts"].to_pylist(), strict=True
        ):
            size = unpacked(sizes, np.int64)
            offsets = np.append(0, np.cumsum(size))
            data = np.frombuffer(unpress.decompress(texts, max_output_size=int(offsets[-1]) + 1), np.uint8)
            train.append(np.unpackbits(np.frombuffer(bits, np.uint8))[: len(size)].astype(bool))
            for low, high in words.slices(offsets):
                own = offsets[low : high + 1] - offsets[low]
                lowered = data[offsets[low] : offsets[high]]
                owner, start, end = words.find(lowered, own, words.NOT_BLANK)
                # The end of each text stands after its last word.
                after = np.searchsorted(owner, np.arange(high - low), side="right")
                hashes.append(np.insert(words.hashes(lowered, start, end), after, END))
                owners.append(np.insert(owner, after, np.arange(high - low)) + low + count)
            count += len(size)
        self.doc_ids = pa.concat_arrays([x.values for x in rows["doc_ids"]])
        self.train = np.concatenate(train)
        self.owner = np.concatenate(owners).astype(np.int32)
        self.lexicon, number = np.unique(np.concatenate(hashes), return_inverse=True)
        self.number = number.astype(np.int32)
        self.begins = np.ones(len(self.number), bool)
        self.begins[1:] = self.owner[1:] != self.owner[:-1]

    def word_counts(self) -> np.ndarray:
        """Training tokens of each word."""
        return np.bincount(self.number[self.train[self.owner]], minlength=len(self.lexicon)).astype(np.int32)

    def occurrences(self) -> np.ndarray:
        """All tokens of each word: as many pairs at most begin with it."""
        return np.bincount(self.number, minlength=len(self.lexicon)).astype(np.int32)

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """First and second word of each distinct pair, its training count, and the pair of every token.

        The start sign stands behind the last word of the lexicon.
        """
        first = np.empty_like(self.number)
        first[1:] = self.number[:-1]
        first[self.begins] = len(self.lexicon)
        key, place = np.unique((first.astype(np.int64) << 32) | self.number, return_inverse=True)
        count = np.bincount(place[self.train[self.owner]], minlength=len(key)).astype(np.int32)
        return (key >> 32).astype(np.int32), (key & 0xFFFFFFFF).astype(np.int32), count, place


def _word_bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Ascends with the hash, so a bucket is a stretch of a lexicon."""
    return (((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


ASKED = "bucket int, block int, a binary, b binary, c binary, d binary, e binary"
ANSWER = "kind int, block int, bucket int, a binary, b binary, c binary"


def _table(schema: str, rows: list[tuple]) -> pa.Table:
    names, kinds = zip(*[part.split() for part in schema.split(", ")], strict=True)
    types = [pa.int32() if k == "int" else pa.binary() for k in kinds]
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
    return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=list(names))


def _ask_words(buckets: int):
    def run(rows: pa.Table) -> pa.Table:
        block, number = Block(rows), rows["block"][0].as_py()
        count, every = block.word_counts(), block.occurrences()
        cut = np.searchsorted(_word_bucket(block.lexicon, buckets), np.arange(buckets + 1))
        return _table(
            ASKED,
            [
                (k, number, packed(block.lexicon[a:b]), packed(count[a:b]), packed(every[a:b]), None, None)
                for k, (a, b) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True))
                if a < b
            ],
        )

    return run


def _histogram(total: np.ndarray) -> bytes:
    n = np.bincount(np.minimum(total, K + 2), minlength=K + 3)[: K + 2]
    return np.concatenate([n, [total.sum(), (total > 0).sum()]]).astype(np.int64).tobytes()


def _answer_words(buckets: int, piece: int):
    """Numbers, total counts and pieces of words; kind 0 is the histogram of the bucket."""

    def run(rows: pa.Table) -> pa.Table:
        bucket = rows["bucket"][0].as_py()
        asked = [unpacked(x, np.uint64) for x in rows["a"].to_pylist()]
        counts = np.concatenate([unpacked(x, np.int32) for x in rows["b"].to_pylist()])
        found, place = np.unique(np.concatenate(asked), return_inverse=True)
        total = np.bincount(place, weights=counts, minlength=len(found)).astype(np.int64)
        every = np.concatenate([unpacked(x, np.int32) for x in rows["c"].to_pylist()])
        every = np.bincount(place, weights=every, minlength=len(found)).astype(np.int64)
        pieces = np.maximum(-(-every // piece), 1).astype(np.int32)
        number = np.where(total > 0, np.arange(len(found)) * buckets + bucket, -1).astype(np.int32)
        cut = np.cumsum([len(x) for x in asked])[:-1]
        out = [(0, -1, bucket, _histogram(total), None, None)]
        for block, own in zip(rows["block"].to_pylist(), np.split(place, cut), strict=True):
            out.append((1, block, bucket, packed(number[own]), packed(total[own]), packed(pieces[own])))
        return _table(ANSWER, out)

    return run


def _known(answers: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number, total count and pieces of every word of a block's lexicon."""
    mine = answers.filter(pa.compute.equal(answers["kind"], 1)).sort_by("bucket")
    number = [unpacked(x, np.int32) for x in mine["a"].to_pylist()]
    total = [unpacked(x, np.int64) for x in mine["b"].to_pylist()]
    pieces = [unpacked(x, np.int32) for x in mine["c"].to_pylist()]
    return np.concatenate(number), np.concatenate(total), np.concatenate(pieces)


def _pair_bucket(context: np.ndarray, piece: np.ndarray, buckets: int) -> np.ndarray:
    spread = words.mixed(context.astype(np.uint64) | (piece.astype(np.uint64) << np.uint64(32)))
    return (spread % np.uint64(buckets)).astype(np.int64)


@dataclass(frozen=True)
class Order:
    """What a block asks of pairs, in the order of the questions.

    ``asked`` are the pairs of known words. A unit is a context in one bucket; ``degree`` pairs of it are asked
    there, none where the block only needs the sums of that piece. ``rank`` is the place of a word's context.
    """

    asked: np.ndarray
    degree: np.ndarray
    bucket: np.ndarray
    context: np.ndarray
    named: np.ndarray
    rank: np.ndarray

    @property
    def contexts(self) -> int:
        return len(self.named)

    @staticmethod
    def of(first: np.ndarray, second: np.ndarray, number: np.ndarray, pieces: np.ndarray, buckets: int) -> Order:
        """``pieces`` has one more entry than ``number``, that of the start sign."""
        named = np.append(number, START_NUMBER)
        contexts = np.unique(first)
        contexts = contexts[named[contexts] >= 0]
        contexts = contexts[np.argsort(named[contexts])]
        rank = np.full(len(named), -1, np.int64)
        rank[contexts] = np.arange(len(contexts))
        size = max(len(contexts), 1)
        owner = np.repeat(np.arange(len(contexts)), pieces[contexts])
        units = np.unique(_pair_bucket(named[contexts][owner], words.runs(pieces[contexts]), buckets) * size + owner)
        asked = np.flatnonzero((rank[first] >= 0) & (number[second] >= 0))
        piece = words.mixed(number[second[asked]].astype(np.uint64)) % pieces[first[asked]].astype(np.uint64)
        bucket = _pair_bucket(named[first[asked]], piece, buckets)
        unit = np.searchsorted(units, bucket * size + rank[first[asked]])
        asked = asked[np.argsort(unit, kind="stable")]
        degree = np.bincount(unit, minlength=len(units))
        return Order(asked, degree, units // size, units % size, named[contexts], rank)


def _ask_pairs(buckets: int, starts: int):
    def run(rows: pa.Table, answers: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return _table(ASKED, [])
        block, block_number = Block(rows), rows["block"][0].as_py()
        number, total, pieces = _known(answers)
        first, second, count, _ = block.pairs()
        order = Order.of(first, second, number, np.append(pieces, starts), buckets)
        upto = np.append(0, np.cumsum(order.degree))
        cut = np.searchsorted(order.bucket, np.arange(buckets + 1))
        out = []
        for k, (a, b) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)):
            if a < b:
                own = order.asked[upto[a] : upto[b]]
                out.append(
                    (
                        k,
                        block_number,
                        packed(order.named[order.context[a:b]].astype(np.int32)),
                        packed(order.degree[a:b].astype(np.int32)),
                        packed(number[second[own]]),
                        packed(count[own]),
                        packed(total[second[own]]),
                    )
                )
        return _table(ASKED, out)

    return run


def _answer_pairs(model: Words):
    """Total counts of pairs and sums of contexts in this bucket; kind 0 is the histogram of the bucket.

    A context's sums are its occurrences, the numbers of its pairs seen 1..K times and the mass that
    P gives to the words seen after it.
    """

    def run(rows: pa.Table) -> pa.Table:
        context = [unpacked(x, np.int32) for x in rows["a"].to_pylist()]
        degree = [unpacked(x, np.int32) for x in rows["b"].to_pylist()]
        second = np.concatenate([unpacked(x, np.int32) for x in rows["c"].to_pylist()])
        count = np.concatenate([unpacked(x, np.int32) for x in rows["d"].to_pylist()])
        seen = np.concatenate([unpacked(x, np.int64) for x in rows["e"].to_pylist()])
        names, its = np.unique(np.concatenate(context), return_inverse=True)
        first = np.repeat(its, np.concatenate(degree))
        key, index, place = np.unique(
            (first.astype(np.int64) << 32) | second, return_index=True, return_inverse=True
        )
        total = np.bincount(place, weights=count, minlength=len(key)).astype(np.int64)
        of = key >> 32
        size = len(names)
        sums = np.zeros((size, K + 1), np.int32)
        sums[:, 0] = np.bincount(of, weights=total, minlength=size)
        for r in range(1, K + 1):
            sums[:, r] = np.bincount(of[total == r], minlength=size)
        held = total > 0
        mass = np.bincount(of[held], weights=model.chance(seen[index])[held], minlength=size)
        out = [(0, -1, rows["bucket"][0].as_py(), _histogram(total), None, None)]
        cut_pairs = np.cumsum([int(x.sum()) for x in degree])[:-1]
        cut_contexts = np.cumsum([len(x) for x in context])[:-1]
        for block, pairs, own in zip(
            rows["block"].to_pylist(), np.split(place, cut_pairs), np.split(its, cut_contexts), strict=True
        ):
            out.append(
                (
                    2,
                    block,
                    rows["bucket"][0].as_py(),
                    packed(total[pairs].astype(np.int32)),
                    packed(sums[own].ravel()),
                    packed(mass[own]),
                )
            )
        return _table(ANSWER, out)

    return run


def backoff(sums: np.ndarray, mass: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Denominator and alpha of contexts from their sums."""
    size = sums[:, 0].astype(float)
    r = np.arange(1, K + 1)
    left = (sums[:, 1:] * (r * (1 - d[1 : K + 1]))).sum(1)
    nothing = (left <= 0) & (size > 0)
    size, left = size + nothing, left + nothing
    seen = size > 0
    alpha = np.where(seen, left / np.maximum(size, 1) / np.maximum(1 - mass, 1e-12), 1.0)
    return size, alpha


def _score(model: Words, d: np.ndarray, buckets: int, starts: int, kind: pa.DataType):
    def run(rows: pa.Table, answers: pa.Table) -> pa.Table:
        names = ["doc_id", "train", "n_tokens", "n_known", "base_score", "score"]
        types = [kind, pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        if not rows.num_rows:
            return pa.table([pa.array([], t) for t in types], names=names)
        block = Block(rows)
        number, total, pieces = _known(answers)
        first, second, _, place = block.pairs()
        order = Order.of(first, second, number, np.append(pieces, starts), buckets)
        mine = answers.filter(pa.compute.equal(answers["kind"], 2)).sort_by("bucket")
        none = [np.zeros(0, np.int32)]
        count = np.concatenate(none + [unpacked(x, np.int32) for x in mine["a"].to_pylist()])
        sums = np.concatenate(none + [unpacked(x, np.int32) for x in mine["b"].to_pylist()])
        mass = np.concatenate([np.zeros(0)] + [unpacked(x, np.float64) for x in mine["c"].to_pylist()])
        whole = [np.bincount(order.context, weights=x, minlength=order.contexts) for x in sums.reshape(-1, K + 1).T]
        mass = np.bincount(order.context, weights=mass, minlength=order.contexts)
        size, alpha = backoff(np.stack(whole, 1), mass, d)
        # A context that training never holds leaves P as it is.
        alpha, size = np.append(alpha, 1.0), np.append(size, 0.0)
        low = model.chance(total)
        chance = alpha[order.rank[first]] * low[second]
        r = np.zeros(len(first), np.int64)
        r[order.asked] = count
        seen = np.flatnonzero(r > 0)
        chance[seen] = d[np.minimum(r[seen], K + 1)] * r[seen] / size[order.rank[first[seen]]]
        n = len(block.train)
        score = np.bincount(block.owner, weights=np.log10(chance)[place], minlength=n)
        plain = np.log10((total + 0.5) / (model.tokens + 0.5 * (model.distinct + 1)))
        base = np.bincount(block.owner, weights=plain[block.number], minlength=n)
        tokens = np.bincount(block.owner, minlength=n)
        known = np.bincount(block.owner, weights=(total > 0)[block.number], minlength=n).astype(np.int64)
        values = [block.doc_ids, block.train, tokens, known, base, score]
        return pa.table([pa.array(v).cast(t) for v, t in zip(values, types, strict=True)], names=names)

    return run


def _sums(answers: DataFrame) -> np.ndarray:
    """Histograms of all buckets added up: one short row per bucket comes to the driver."""
    rows = answers.where("kind = 0").select("a").toArrow()["a"].to_pylist()
    return sum((np.frombuffer(x, np.int64) for x in rows), np.zeros(K + 4, np.int64))


def katz_scores(
    docs: DataFrame,
    train: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    block_bytes: int = BLOCK_BYTES,
    piece: int = PIECE,
) -> DataFrame:
    """doc_id, train, n_tokens, n_known, train_tokens, base_score and score of every document.

    ``train`` is a condition on ``docs``; rows for which it is true are learned from. ``base_score`` is the
    add-half unigram score.
    """
    spark = docs.sparkSession
    rows = picked(docs.withColumn("_train", F.coalesce(train, F.lit(False))), doc_id=id_col, text=text_col, train="_train")
    size, count = rows.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    size, starts = size or 0, max(1, -(-count // piece))
    blocks = max(1, -(-size // block_bytes))
    buckets = max(blocks, partitions(spark))
    block = F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int").alias("block")
    kind = rows.schema["doc_id"].dataType.simpleString()
    blobs = rows.select(block, "doc_id", "train", "text").mapInArrow(
        _blobs(blocks), f"block int, doc_ids array<{kind}>, train binary, sizes binary, texts binary"
    )
    by_block = blobs.groupBy("block")
    known = by_block.applyInArrow(_ask_words(buckets), ASKED)
    known = stored(known.groupBy("bucket").applyInArrow(_answer_words(buckets, piece), ANSWER))
    n = _sums(known)
    model = Words.of(n[: K + 2], int(n[-2]), int(n[-1]))
    mine = known.where("kind = 1")
    asked = by_block.cogroup(mine.groupBy("block")).applyInArrow(_ask_pairs(buckets, starts), ASKED)
    pairs = stored(asked.groupBy("bucket").applyInArrow(_answer_pairs(model), ANSWER))
    d = discounts(_sums(pairs)[: K + 2])
    answers = mine.union(pairs.where("kind = 2"))
    arrow = pa.schema(rows.select("doc_id").limit(0).toArrow().schema).field("doc_id").type
    scored = by_block.cogroup(answers.groupBy("block")).applyInArrow(
        _score(model, d, buckets, starts, arrow),
        f"doc_id {kind}, train boolean, n_tokens bigint, n_known bigint, base_score double, score double",
    )
    return scored.withColumn("train_tokens", F.lit(model.tokens).cast("bigint"))
