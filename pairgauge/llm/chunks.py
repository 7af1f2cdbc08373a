"""Repeated passages across documents: content-defined anchors find candidates, equal windows decide.

What counts. A window is ``MIN_WORDS`` words in a row with the bytes between them. A word is repeated where
it lies in a window that another document holds too, and neighbouring repeated words join into a span, so
a span is the true common stretch and every common passage of ``MIN_WORDS`` words or more is in one.

Candidates. Of the ``GRAM``-word grams of each window the least hash is an anchor. Which gram that is
depends on the window alone, so documents that share a window share its anchor: none can be missed. An
anchor is asked for once per block of documents, so a passage in a third of all documents is no hot group.

Decision. Only windows around shared anchors are asked for, by 128-bit digests with the smallest id that holds
them. The document with the smallest id keeps its text, from all others it can be removed.

Content-defined chunks by a gear hash (``chunked``) are a table of their own: a byte's random value enters and
all others move up one bit, so 32 bits see the last 32 bytes; a chunk ends where the top bits are zero and it
has its least length. Spans state how many chunks begin in them.

Defined cases: rows with one id are one document, rows without an id together another; a text that is
null or empty has no chunks and no spans; a stretch without a cut is one chunk whatever its length; repeats
inside one document are left alone; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .common import partitions, picked, stored, takes_rows
from .katz import _word_bucket, packed, unpacked

MIN_BYTES = 16
CUT_BITS = 5
MIN_WORDS = 20
GRAM = 8
BLOCK_BYTES = 8 << 20
BLOCK_ROWS = 200_000
_WINDOW = 32
_GAP = 255  # never a byte of UTF-8

GEAR = np.random.default_rng(11).integers(1, 1 << 32, 256, dtype=np.uint32)
GEAR[_GAP] = 0


def cuts(data: np.ndarray, offsets: np.ndarray) -> list[list[int]]:
    """Ends of the chunks of each text, counted from its first byte; the last one is its length."""
    count = len(offsets) - 1
    spread = np.full(len(data) + _WINDOW * count, _GAP, np.uint8)
    begin = offsets[:-1] + _WINDOW * np.arange(count)
    for k in range(count):
        spread[begin[k] : begin[k] + offsets[k + 1] - offsets[k]] = data[offsets[k] : offsets[k + 1]]
    h = GEAR[spread]
    for bits in (1, 2, 4, 8, 16):
        h[bits:] = h[bits:] + (h[:-bits] << np.uint32(bits))
    whole = np.ones(len(spread), bool)
    whole[:-1] = (spread[1:] & 0xC0) != 0x80
    at = np.flatnonzero((h >> np.uint32(32 - CUT_BITS) == 0) & (spread != _GAP) & whole) + 1
    share = np.searchsorted(at, np.append(begin, len(spread)))
    out = []
    for k in range(count):
        size = int(offsets[k + 1] - offsets[k])
        ends, last = [], 0
        for end in (at[share[k] : share[k + 1]] - begin[k]).tolist():
            if end - last >= MIN_BYTES:
                ends.append(end)
                last = end
        if last < size:
            ends.append(size)
        out.append(ends)
    return out


def _chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in takes_rows(batches):
        offsets, data = words.utf8(batch.column(2))
        for low, high in words.slices(offsets):
            own = offsets[low : high + 1] - offsets[low]
            raw = data[offsets[low] : offsets[high]]
            ends_of = cuts(raw, own)
            each = np.array([len(e) for e in ends_of], np.int64)
            if not each.sum():
                continue
            end = np.concatenate([np.array(e, np.int64) + own[k] for k, e in enumerate(ends_of)])
            owner = np.repeat(np.arange(high - low), each)
            number = words.runs(each)
            start = np.where(number == 0, own[owner], np.append(0, end[:-1]))
            points = np.append(0, np.cumsum((raw & 0xC0) != 0x80))
            _, begun, _ = words.find(raw, own, words.NOT_BLANK)
            held = np.searchsorted(begun, end) - np.searchsorted(begun, start)
            rows = pa.array(owner + low)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(rows),
                    batch.column(1).take(rows),
                    pa.array(number.astype(np.int32)),
                    pa.array(points[start] - points[own[owner]]),
                    pa.array((points[end] - points[start])),
                    pa.array(held.astype(np.int32)),
                    pa.array(words.hashes(raw, start, end).view(np.int64)),
                    pa.array(words.hashes(raw, start, end, again=True).view(np.int64)),
                ],
                ["doc_id", "row", "number", "start", "length", "n_words", "d1", "d2"],
            )


def chunked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every chunk of every text: its number, code points, words and digest."""
    rows = picked(docs, doc_id=id_col, text=text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    rows = rows.select("doc_id", F.monotonically_increasing_id().alias("row"), "text")
    return rows.mapInArrow(
        _chunked,
        f"doc_id {kind}, row bigint, number int, start bigint, length bigint, n_words int, "
        "d1 bigint, d2 bigint",
    )


# Blocks of documents


def _blobs(block_bytes: int):
    """Texts in the order of the rows, about ``block_bytes`` together, compressed; ``block`` is the first row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        first, held, size, count = TaskContext.get().partitionId() << 33, [], 0, 0

        def blob() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks()
            offsets, data = words.utf8(rows["text"])
            ids = pa.concat_arrays(rows["doc_id"].chunks)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([first], pa.int64()),
                    pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
                    pa.array([packed(np.diff(offsets))], pa.binary()),
                    pa.array([press.compress(data.tobytes())], pa.binary()),
                ],
                ["block", "doc_ids", "sizes", "texts"],
            )

        for batch in takes_rows(batches):
            offsets, _ = words.utf8(batch.column(1))
            for low, high in words.slices(offsets, block_bytes):
                own = int(offsets[high] - offsets[low])
                if held and (size + own > block_bytes or count + high - low > BLOCK_ROWS):
                    yield blob()
                    first, held, size, count = first + count, [], 0, 0
                held.append(batch.slice(low, high - low))
                size, count = size + own, count + high - low
        if held:
            yield blob()

    return run


@dataclass
class Part:
    """Some texts of a block: their bytes and words, and the places and hashes of their anchors."""

    low: int
    raw: np.ndarray
    own: np.ndarray
    owner: np.ndarray
    start: np.ndarray
    end: np.ndarray
    at: np.ndarray
    anchor: np.ndarray

    def windows(self, min_words: int) -> np.ndarray:
        """For each first word, whether its window ends in the same text."""
        whole = np.zeros(len(self.owner), bool)
        n = max(len(whole) - min_words + 1, 0)
        whole[:n] = self.owner[:n] == self.owner[len(whole) - n :]
        return whole


def anchors(owner: np.ndarray, gram: np.ndarray, min_words: int) -> np.ndarray:
    """Places of the grams that are the least of a window; grams stand at their first words."""
    size = min_words - min(GRAM, min_words) + 1
    n = len(owner) - min_words + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    least = gram[:n].copy()
    for k in range(1, size):
        np.minimum(least, gram[k : k + n], out=least)
    whole = owner[:n] == owner[min_words - 1 :]
    chosen = np.zeros(len(gram), bool)
    for k in range(size):
        chosen[k : k + n] |= whole & (gram[k : k + n] == least)
    return np.flatnonzero(chosen)


class Block:
    """The texts of a blob in parts of about a megabyte, with the distinct anchors of all."""

    def __init__(self, blob: dict, doc_ids: pa.Array, min_words: int) -> None:
        self.first, self.doc_ids, self.parts = blob["block"], doc_ids, []
        offsets = np.append(0, np.cumsum(unpacked(blob["sizes"], np.int64)))
        data = zstandard.ZstdDecompressor().decompress(blob["texts"], max_output_size=int(offsets[-1]) + 1)
        data = np.frombuffer(data, np.uint8)
        width = min(GRAM, min_words)
        for low, high in words.slices(offsets):
            own, raw = offsets[low : high + 1] - offsets[low], data[offsets[low] : offsets[high]]
            owner, start, end = words.find(raw, own, words.NOT_BLANK)
            gram = words.hashes(raw, start[: max(len(start) - width + 1, 0)], end[width - 1 :])
            at = anchors(owner, gram, min_words)
            self.parts.append(Part(low, raw, own, owner, start, end, at, gram[at]))
        found = np.concatenate([p.anchor for p in self.parts])
        rows = np.concatenate([p.owner[p.at] + p.low for p in self.parts])
        self.anchors, self.place = np.unique(found, return_inverse=True)
        least, most = np.full(len(self.anchors), len(doc_ids)), np.full(len(self.anchors), -1)
        np.minimum.at(least, self.place, rows)
        np.maximum.at(most, self.place, rows)
        self.several = least < most
        # Identities ascend with the ids; no id is -1.
        self.ids, self.identity = _ranked(doc_ids)

    def candidates(self, answers: pa.Table, buckets: int, min_words: int) -> Candidates:
        """The windows to ask for, from what is known of the anchors."""
        cut = np.searchsorted(_word_bucket(self.anchors, buckets), np.arange(buckets + 1))
        shared = np.zeros(len(self.anchors), bool)
        mine = answers.filter(pc.equal(answers["kind"], 1))
        for bucket, bits in zip(mine["bucket"].to_pylist(), mine["a"].to_pylist(), strict=True):
            a, b = cut[bucket], cut[bucket + 1]
            shared[a:b] = np.unpackbits(np.frombuffer(bits, np.uint8), count=b - a)
        return Candidates(self, shared[self.place], min_words)


def _ranked(ids: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Distinct ids in their order, and the place of each in it; -1 for null."""
    coded = ids.dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order) + 1, np.int64)
    rank[order] = np.arange(len(order))
    rank[-1] = -1
    code = pc.fill_null(coded.indices, len(order)).to_numpy()
    return coded.dictionary.take(pa.array(order)), rank[code]


class Candidates:
    """The distinct windows of a block around shared anchors: digests, smallest identity, whether several."""

    def __init__(self, block: Block, shared: np.ndarray, min_words: int) -> None:
        size = min_words - min(GRAM, min_words) + 1
        self.at, h1, h2, identity, done = [], [], [], [], 0
        for p in block.parts:
            near = np.zeros(len(p.owner) + 1, np.int64)
            hit = p.at[shared[done : done + len(p.at)]]
            done += len(p.at)
            np.add.at(near, np.maximum(hit - size + 1, 0), 1)
            np.add.at(near, hit + 1, -1)
            at = np.flatnonzero((np.cumsum(near)[:-1] > 0) & p.windows(min_words))
            self.at.append(at)
            end = p.end[at + min_words - 1]
            h1.append(words.hashes(p.raw, p.start[at], end))
            h2.append(words.hashes(p.raw, p.start[at], end, again=True))
            identity.append(block.identity[p.owner[at] + p.low])
        h1, h2, identity = np.concatenate(h1), np.concatenate(h2), np.concatenate(identity)
        order = np.lexsort((h2, h1))
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(h1[order]) != 0) | (np.diff(h2[order]) != 0)
        self.place = np.empty(len(order), np.int64)
        self.place[order] = np.cumsum(new) - 1
        self.h1, self.h2 = h1[order][new], h2[order][new]
        self.least, self.several = _least(identity, self.place, len(self.h1))


def _least(identity: np.ndarray, place: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The smallest identity of each item that is an id, else -1, and whether it has several identities."""
    beyond = np.iinfo(np.int64).max
    lowest, highest, named = np.full(size, beyond), np.full(size, -1), np.full(size, beyond)
    np.minimum.at(lowest, place, identity)
    np.maximum.at(highest, place, identity)
    np.minimum.at(named, place, np.where(identity < 0, beyond, identity))
    return np.where(named == beyond, -1, named), lowest < highest


def _listed(ids: list[pa.Array], kind: pa.DataType) -> pa.Array:
    places = np.append(0, np.cumsum([len(x) for x in ids])).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(places), pa.concat_arrays([pa.array([], kind), *ids]))


def _message(own: np.ndarray, ids: pa.Array) -> tuple[bytes, pa.Array]:
    """Identities as places in a list of the ids that occur."""
    used, place = np.unique(own[own >= 0], return_inverse=True)
    out = np.full(len(own), -1, np.int32)
    out[own >= 0] = place
    return packed(out), ids.take(pa.array(used))


def _bits(x: np.ndarray) -> bytes:
    return np.packbits(x).tobytes()


def _table(rows: list[tuple], types: list[pa.DataType], names: list[str], ids: list[pa.Array] | None = None, kind=None):
    columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(types), types, strict=True)]
    return pa.table(columns + ([] if ids is None else [_listed(ids, kind)]), names=names)


INT, LONG, BYTES = pa.int32(), pa.int64(), pa.binary()
ANSWER = ["kind", "block", "bucket", "a", "b", "ids"]


def _opened(rows: pa.Table | pa.RecordBatch, k: int, min_words: int) -> Block:
    blob = {name: rows[name][k].as_py() for name in ("block", "sizes", "texts")}
    return Block(blob, rows["doc_ids"][k].values, min_words)


def _ask_anchors(buckets: int, min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in takes_rows(batches):
            for k in range(batch.num_rows):
                block, out = _opened(batch, k, min_words), []
                cut = np.searchsorted(_word_bucket(block.anchors, buckets), np.arange(buckets + 1)).tolist()
                for bucket in range(buckets):
                    a, b = cut[bucket], cut[bucket + 1]
                    if a < b:
                        out.append((bucket, block.first, packed(block.anchors[a:b]), _bits(block.several[a:b])))
                yield from _table(out, [INT, LONG, BYTES, BYTES], ["bucket", "block", "a", "b"]).to_batches()

    return run


def _answer_anchors(kind: pa.DataType):
    """Whether several rows hold an anchor."""

    def run(rows: pa.Table) -> pa.Table:
        asked = [unpacked(x, np.uint64) for x in rows["a"].to_pylist()]
        flags = [np.unpackbits(np.frombuffer(x, np.uint8), count=len(y)) for x, y in zip(rows["b"].to_pylist(), asked, strict=True)]
        found, place = np.unique(np.concatenate(asked), return_inverse=True)
        shared = np.bincount(place, weights=1 + np.concatenate(flags), minlength=len(found)) > 1
        bucket, out = rows["bucket"][0].as_py(), []
        for block, own in zip(rows["block"].to_pylist(), np.split(place, np.cumsum([len(x) for x in asked])[:-1]), strict=True):
            out.append((1, block, bucket, _bits(shared[own]), None))
        return _table(out, [INT, LONG, INT, BYTES, BYTES], ANSWER, [pa.array([], kind)] * len(out), kind)

    return run


WINDOWS = ["bucket", "block", "a", "b", "c", "d", "ids"]


def _ask_windows(buckets: int, min_words: int, kind: pa.DataType):
    def run(rows: pa.Table, answers: pa.Table) -> pa.Table:
        out, ids = [], []
        if rows.num_rows:
            block = _opened(rows, 0, min_words)
            found = block.candidates(answers, buckets, min_words)
            cut = np.searchsorted(_word_bucket(found.h1, buckets), np.arange(buckets + 1)).tolist()
            for k in range(buckets):
                a, b = cut[k], cut[k + 1]
                if a < b:
                    least, named = _message(found.least[a:b], block.ids)
                    out.append((k, block.first, packed(found.h1[a:b]), packed(found.h2[a:b]), least, _bits(found.several[a:b])))
                    ids.append(named)
        return _table(out, [INT, LONG, BYTES, BYTES, BYTES, BYTES], WINDOWS, ids, kind)

    return run


def _answer_windows(kind: pa.DataType):
    """Whether several documents hold a window, and the smallest id among them."""

    def run(rows: pa.Table) -> pa.Table:
        h1 = [unpacked(x, np.uint64) for x in rows["a"].to_pylist()]
        each = [len(x) for x in h1]
        h1, h2 = np.concatenate(h1), np.concatenate([unpacked(x, np.uint64) for x in rows["b"].to_pylist()])
        flags = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=n) for x, n in zip(rows["d"].to_pylist(), each, strict=True)])
        lists = [x.values for x in rows["ids"]]
        ids, rank = _ranked(pa.concat_arrays([pa.array([], kind), *lists]))
        base = np.repeat(np.append(0, np.cumsum([len(x) for x in lists]))[:-1], each)
        least = np.concatenate([unpacked(x, np.int32) for x in rows["c"].to_pylist()]).astype(np.int64)
        identity = np.where(least < 0, -1, np.append(rank, -1)[np.where(least < 0, -1, least + base)])
        order = np.lexsort((h2, h1))
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(h1[order]) != 0) | (np.diff(h2[order]) != 0)
        place = np.empty(len(order), np.int64)
        place[order] = np.cumsum(new) - 1
        size = int(new.sum())
        first, several = _least(identity, place, size)
        several |= np.bincount(place, weights=flags, minlength=size) > 0
        bucket, out, named = rows["bucket"][0].as_py(), [], []
        for block, own in zip(rows["block"].to_pylist(), np.split(place, np.cumsum(each)[:-1]), strict=True):
            code, its = _message(np.where(several[own], first[own], -1), ids)
            out.append((2, block, bucket, _bits(several[own]), code))
            named.append(its)
        return _table(out, [INT, LONG, INT, BYTES, BYTES], ANSWER, named, kind)

    return run


def _joined(p: Part, at: np.ndarray, first: np.ndarray, other: np.ndarray, min_words: int):
    """Spans of a part from its repeated windows: first and last word, removable code points, first document, chunks."""

    def covered(places: np.ndarray) -> np.ndarray:
        edge = np.zeros(len(p.owner) + 1, np.int64)
        edge[: len(p.owner)] = np.bincount(places, minlength=len(p.owner))
        edge -= np.bincount(places + min_words, minlength=len(p.owner) + 1)
        return np.cumsum(edge)[:-1] > 0

    held, free = covered(at), covered(at[other])
    new = held.copy()
    new[1:] &= ~held[:-1] | (p.owner[1:] != p.owner[:-1])
    span = np.cumsum(new) - 1
    begin = np.flatnonzero(new)
    last = np.flatnonzero(held & np.append(new[1:] | ~held[1:], True))
    points = np.append(0, np.cumsum((p.raw & 0xC0) != 0x80))
    on = free & np.append(free[1:] & ~new[1:], False)
    upto = np.where(on, np.append(p.start[1:], 0), p.end)
    sizes = np.where(free, points[upto] - points[p.start], 0)
    removable = np.bincount(span[held], weights=sizes[held], minlength=len(begin)).astype(np.int64)
    beyond = np.iinfo(np.int64).max
    least = np.full(len(begin), beyond)
    np.minimum.at(least, span[at[other]], first[other])
    owner = p.owner[begin]
    rows = np.unique(owner)
    texts = [p.raw[p.own[k] : p.own[k + 1]] for k in rows]
    ends = cuts(np.concatenate(texts), np.append(0, np.cumsum([len(x) for x in texts])))
    starts = np.concatenate([np.append(0, e[:-1]) + p.own[k] for k, e in zip(rows.tolist(), ends, strict=True)])
    n_chunks = np.searchsorted(starts, p.end[last]) - np.searchsorted(starts, p.start[begin])
    base = points[p.own[owner]]
    length = points[p.end[last]] - points[p.start[begin]]
    return owner, points[p.start[begin]] - base, length, last - begin + 1, n_chunks, removable, np.where(least == beyond, -1, least)


def _spans(buckets: int, min_words: int, kind: pa.DataType):
    names = ["doc_id", "start", "length", "n_words", "n_chunks", "removable", "first_doc", "row"]
    types = [kind, LONG, LONG, LONG, LONG, LONG, kind, LONG]

    def run(rows: pa.Table, answers: pa.Table) -> pa.Table:
        none = pa.table([pa.array([], t) for t in types], names=names)
        if not rows.num_rows:
            return none
        block = _opened(rows, 0, min_words)
        found = block.candidates(answers, buckets, min_words)
        cut = np.searchsorted(_word_bucket(found.h1, buckets), np.arange(buckets + 1))
        several, first = np.zeros(len(found.h1), bool), np.full(len(found.h1), -1)
        mine, lists, done = answers.filter(pc.equal(answers["kind"], 2)), [], 0
        for bucket, bits, code, ids in zip(*[mine[c].to_pylist() for c in "bucket a b".split()], mine["ids"], strict=True):
            a, b = cut[bucket], cut[bucket + 1]
            several[a:b] = np.unpackbits(np.frombuffer(bits, np.uint8), count=b - a)
            own = unpacked(code, np.int32)
            first[a:b] = np.where(own < 0, -1, own + done)
            lists.append(ids.values)
            done += len(ids.values)
        named, rank = _ranked(pa.concat_arrays([block.doc_ids, *lists]))
        mine, rank = rank[: len(block.doc_ids)], np.append(rank[len(block.doc_ids) :], -1)
        first, out, begun = rank[first], [], 0
        for p, at in zip(block.parts, found.at, strict=True):
            place = found.place[begun : begun + len(at)]
            begun += len(at)
            held = several[place]
            if not held.any():
                continue
            at, place = at[held], place[held]
            other = mine[p.owner[at] + p.low] != first[place]
            owner, start, length, n_words, n_chunks, removable, least = _joined(p, at, first[place], other, min_words)
            row = pa.array(owner + p.low)
            who = named.take(pa.array(least, mask=least < 0))
            values = [block.doc_ids.take(row), start, length, n_words, n_chunks, removable, who, owner + p.low + block.first]
            out.append(pa.table([pa.array(v).cast(t) for v, t in zip(values, types, strict=True)], names=names))
        return pa.concat_tables([none, *out])

    return run


def repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_words: int = MIN_WORDS,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Spans of code points that other documents hold too.

    doc_id, start, length, n_words, n_chunks; ``removable`` of its code points belong to a document with a
    smaller id, the smallest of which is ``first_doc``; ``row`` tells rows of one id apart.
    """
    rows = picked(docs, doc_id=id_col, text=text_col)
    id_kind = rows.schema["doc_id"].dataType.simpleString()
    kind = pa.schema(rows.select("doc_id").limit(0).toArrow().schema).field("doc_id").type
    # Stored, so that blocks stay what they are however often they are read; equal rows need not meet in one.
    blobs = stored(rows.mapInArrow(_blobs(block_bytes), f"block bigint, doc_ids array<{id_kind}>, sizes binary, texts binary"))
    buckets = max(blobs.count(), partitions(docs.sparkSession))
    answer = f"kind int, block bigint, bucket int, a binary, b binary, ids array<{id_kind}>"
    asked = blobs.mapInArrow(_ask_anchors(buckets, min_words), "bucket int, block bigint, a binary, b binary")
    shared = stored(asked.groupBy("bucket").applyInArrow(_answer_anchors(kind), answer))
    by_block = blobs.groupBy("block")
    asked = by_block.cogroup(shared.groupBy("block")).applyInArrow(
        _ask_windows(buckets, min_words, kind),
        f"bucket int, block bigint, a binary, b binary, c binary, d binary, ids array<{id_kind}>",
    )
    answers = shared.union(asked.groupBy("bucket").applyInArrow(_answer_windows(kind), answer))
    return by_block.cogroup(answers.groupBy("block")).applyInArrow(
        _spans(buckets, min_words, kind),
        f"doc_id {id_kind}, start bigint, length bigint, n_words bigint, n_chunks bigint, removable bigint, "
        f"first_doc {id_kind}, row bigint",
    )
