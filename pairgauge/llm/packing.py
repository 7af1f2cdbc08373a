"""Packing of whole tokenised documents into sequences, balanced by estimated attention cost.

A document is its ids and one closing id. Full pieces of ``capacity`` ids are sequences of their own.
The rest of each document goes to a group of a few thousand by the hash of its id; there, longest
first, it joins the cheapest sequence that has room, where a piece of n ids costs ``linear * n + n*n``.
The number of sequences is what the ids need at least; a rest that fits nowhere whole is cut over the
sequences with the most room, so at most one sequence of a group stays unfilled.

Ids come from the tokenizer itself, but once for each distinct pre-token: texts are cut by the
byte-level pattern on arrays of code points, and a bounded cache maps a pre-token's hash to its ids.
Texts that hold a special token go through the tokenizer whole.

Defined cases: a null or empty text is the closing id alone; a very long text is many pieces; rows that
repeat a doc_id are packed one by one; other columns are ignored; an empty table gives no pieces.
"""

from __future__ import annotations

import heapq
import unicodedata
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .common import REMEMBERED, picked, takes_rows

CAPACITY = 1024
GROUP_DOCUMENTS = 4096
LINEAR_COST = 6 * 1024.0
CACHE_TOKENS = 1_500_000

_LETTER, _NUMBER, _SPACE, _OTHER = 0, 1, 2, 3


@cache
def _classes() -> np.ndarray:
    """The pattern's class of every code point."""
    kind = np.full(0x110000, _OTHER, np.uint8)
    for point in range(0x110000):
        major = unicodedata.category(chr(point))[0]
        if major == "L":
            kind[point] = _LETTER
        elif major == "N":
            kind[point] = _NUMBER
    kind[[9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = _SPACE
    kind[0x2000:0x200B] = _SPACE
    return kind


def pretokens(points: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Start of every pre-token of texts laid end to end as code points.

    Runs of letters, of numbers and of other signs, each with one blank before it; contractions after
    an apostrophe that stands alone; white space, of which the last one before a sign is apart.
    """
    n = len(points)
    if n == 0:
        return np.zeros(0, np.int64)
    kind = _classes()[points]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    change = np.ones(n, bool)
    change[1:] = (kind[1:] != kind[:-1]) | edge[1:n]
    space = kind == _SPACE
    # The last white space of a run before a sign is cut off from the run.
    last = np.zeros(n, bool)
    last[:-1] = space[:-1] & ~space[1:] & ~edge[1:n]
    change |= last
    # A blank joins the run that follows it.
    joined = last & (points == 32)
    change[1:] &= ~joined[:-1]
    # Contractions: an apostrophe that opens a run, not after a joined blank, before s t m d re ve ll.
    mark = np.flatnonzero((points == 39) & change)
    if len(mark):
        ends = offsets[np.searchsorted(offsets, mark, side="right")]
        at = lambda k: np.where(mark + k < ends, points[np.minimum(mark + k, n - 1)], 0)
        one, two = at(1), at(2)
        short = np.isin(one, [ord(c) for c in "stmd"])
        pair = np.zeros(len(mark), bool)
        for a, b in ("re", "ve", "ll"):
            pair |= (one == ord(a)) & (two == ord(b))
        length = np.where(short, 2, np.where(pair, 3, 0))
        mark, length, ends = mark[length > 0], length[length > 0], ends[length > 0]
        change[mark + 1] = False
        after = mark + length
        inside = after < ends
        change[after[inside]] = True
    return np.flatnonzero(change)


class Encoder:
    """Ids of texts by a tokenizer file, with a cache of pre-tokens."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = list(
            {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        )
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.first = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint16)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint16)

    def _learn(self, keys: np.ndarray, texts: list[str]) -> None:
        if len(self.keys) + len(keys) > CACHE_TOKENS:
            self._clear()
        # A line break keeps pre-tokens apart only where the pattern does, so each is encoded alone.
        found = [self.whole(t) for t in texts]
        size = np.array([len(f) for f in found], np.int64)
        first = len(self.ids) + np.cumsum(size) - size
        self.ids = np.concatenate([self.ids, *found])
        place = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, place, keys)
        self.first = np.insert(self.first, place, first)
        self.size = np.insert(self.size, place, size)

    def slice(self, text: str, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts laid end to end, and how many each text has; offsets count code points."""
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        start = pretokens(points, offsets)
        end = np.append(start[1:], len(points))
        keys, inverse = np.unique(_point_hashes(points, start, end), return_inverse=True)
        known = np.isin(keys, self.keys, assume_unique=True)
        if not known.all():
            example = np.zeros(len(keys), np.int64)
            example[inverse] = np.arange(len(inverse))
            new = np.flatnonzero(~known)
            cut = [text[start[e] : end[e]] for e in example[new]]
            before = len(self.keys)
            self._learn(keys[new], cut)
            if len(self.keys) < before + len(new):  # the cache began anew
                rest = np.flatnonzero(known)
                if len(rest):
                    self._learn(keys[rest], [text[start[e] : end[e]] for e in example[rest]])
        place = np.searchsorted(self.keys, keys)
        first, size = self.first[place][inverse], self.size[place][inverse]
        ids = self.ids[np.repeat(first, size) + words.runs(size)]
        owner = np.searchsorted(offsets, start, side="right") - 1
        each = np.bincount(owner, weights=size, minlength=len(offsets) - 1).astype(np.int64)
        return ids, each

    def batch(self, column: pa.Array) -> Iterator[tuple[int, list[np.ndarray]]]:
        """Row number of the first text of a slice, and the ids of its texts."""
        texts = pc.fill_null(column, "")
        places = np.append(0, np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)))
        for low, high in words.slices(places.astype(np.int64)):
            part = texts.slice(low, high - low).to_pylist()
            odd = {k: self.whole(t) for k, t in enumerate(part) if any(s in t for s in self.special)}
            plain = ["" if k in odd else t for k, t in enumerate(part)]
            offsets = np.append(0, np.cumsum([len(t) for t in plain])).astype(np.int64)
            ids, each = self.slice("".join(plain), offsets)
            cut = np.split(ids, np.cumsum(each)[:-1])
            yield low, [odd.get(k, own) for k, own in enumerate(cut)]


def _point_hashes(points: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    up, down = words._raised(len(points) + 1)
    value = words.mixed(points.astype(np.uint64) + np.uint64(1))
    total = np.zeros(len(points) + 1, np.uint64)
    np.cumsum(value * up[: len(points)], out=total[1:])
    return words.mixed((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


_encoders: dict[str, Encoder] = {}
REMEMBERED.append(_encoders.clear)


def encoder(path: str) -> Encoder:
    """One for each worker process, so that the cache lives through many tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


PIECE = [
    ("start", pa.int64()),
    ("length", pa.int64()),
    ("ids_crc32", pa.int64()),
    ("doc_tokens", pa.int64()),
    ("ids", pa.binary()),
]


def _tokenised(path: str, capacity: int, closing: int, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(path)
        for batch in takes_rows(batches):
            for low, texts in known.batch(batch.column(1)):
                owner, rows = [], []
                for k, body in enumerate(texts):
                    ids = np.append(body, np.uint16(closing))
                    for at in range(0, len(ids), capacity):
                        piece = ids[at : at + capacity]
                        whole = len(piece) == capacity
                        owner.append(low + k)
                        rows.append(
                            (
                                at,
                                len(piece),
                                _crc(piece) if whole else None,
                                len(ids),
                                piece.tobytes() if keep_ids or not whole else None,
                            )
                        )
                columns = zip(*rows, strict=True)
                made = [pa.array(c, type=t) for c, (_, t) in zip(columns, PIECE, strict=True)]
                ids_of = batch.column(0).take(pa.array(owner))
                yield pa.RecordBatch.from_arrays([ids_of, *made], ["doc_id", *[n for n, _ in PIECE]])

    return run


def assign(lengths: np.ndarray, capacity: int, linear: float) -> list[list[tuple[int, int, int]]]:
    """Sequences as lists of (document, first id, ids): longest document first, cheapest fitting sequence.

    Sequences stand in one heap per remaining room, and a tree over rooms keeps the cheapest of each
    range, so a document costs a few steps however many sequences there are.
    """
    count = -(-int(lengths.sum()) // capacity)
    leaves = 1 << int(capacity).bit_length()
    heaps: list[list[tuple[float, int]]] = [[] for _ in range(leaves)]
    heaps[capacity] = [(0.0, s) for s in range(count)]
    nothing = (float("inf"), -1, -1)
    tree = [nothing] * (2 * leaves)

    def refresh(room: int) -> None:
        at = leaves + room
        tree[at] = (*heaps[room][0], room) if heaps[room] else nothing
        at >>= 1
        while at:
            tree[at] = min(tree[2 * at], tree[2 * at + 1])
            at >>= 1

    def cheapest(least: int) -> tuple[float, int, int]:
        best, low, high = nothing, leaves + least, 2 * leaves
        while low < high:
            if low & 1:
                best = min(best, tree[low])
                low += 1
            if high & 1:
                high -= 1
                best = min(best, tree[high])
            low >>= 1
            high >>= 1
        return best

    refresh(capacity)
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(count)]

    def place(document: int, first: int, size: int, cost: float, sequence: int, room: int) -> None:
        heapq.heappop(heaps[room])
        refresh(room)
        out[sequence].append((document, first, size))
        left = room - size
        if left:
            heapq.heappush(heaps[left], (cost + linear * size + float(size) * size, sequence))
            refresh(left)

    for document in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[document])
        cost, sequence, room = cheapest(size)
        if sequence >= 0:
            place(document, 0, size, cost, sequence, room)
            continue
        first = 0
        while first < size:  # cut over the emptiest sequences
            room = next(r for r in range(capacity, 0, -1) if heaps[r])
            cost, sequence = heaps[room][0]
            part = min(room, size - first)
            place(document, first, part, cost, sequence, room)
            first += part
    return out


def _packed(capacity: int, linear: float, keep_ids: bool):
    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([(c, "ascending") for c in ("doc_id", "start", "ids_crc")])
        ids = [np.frombuffer(x, np.uint16) for x in group["ids"].to_pylist()]
        lengths = np.array([len(x) for x in ids], np.int64)
        starts = group["start"].to_numpy()
        owner, rows = [], []
        number = group["group"][0].as_py()
        for k, pieces in enumerate(assign(lengths, capacity, linear)):
            offset = 0
            for document, first, size in pieces:
                part = ids[document][first : first + size]
                owner.append(document)
                rows.append(
                    (
                        int(starts[document]) + first,
                        size,
                        _crc(part),
                        (number << 32) + k,
                        offset,
                        part.tobytes() if keep_ids else None,
                    )
                )
                offset += size
        kinds = [pa.int64()] * 5 + [pa.binary()]
        made = [pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
        at = pa.array(owner)
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
        return pa.Table.from_arrays(
            [
                group["doc_id"].take(at), *made[:3], group["doc_tokens"].take(at), *made[3:],
            ],
            names,
        )

    return run


def pack(
    docs: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    closing: int = 0,
    linear_cost: float = LINEAR_COST,
    group_documents: int = GROUP_DOCUMENTS,
    keep_ids: bool = True,
) -> DataFrame:
    """One row per piece: where it stands in its document and in its sequence, and its ids.

    ``ids`` holds little-endian unsigned 16-bit ids; without ``keep_ids`` it is null and only the
    unfinished last pieces of documents are shuffled with theirs.
    """
    rows = picked(docs, doc_id=id_col, text=text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    groups = max(1, -(-rows.select("doc_id").count() // group_documents))
    pieces = rows.mapInArrow(
        _tokenised(tokenizer, capacity, closing, keep_ids),
        f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, ids binary",
    )
    # One pass over the texts feeds both kinds of pieces: the group key of a full piece spreads it alike.
    key = F.pmod(F.xxhash64("doc_id", "start", F.crc32("ids")), F.lit(groups))
    rest = pieces.withColumn("ids_crc", F.coalesce(F.crc32("ids"), F.lit(0))).withColumn("group", key)
    schema = (
        f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
        "sequence_id bigint, offset bigint, ids binary"
    )
    return rest.groupBy("group").applyInArrow(_mixed(capacity, linear_cost, keep_ids), schema)


def _mixed(capacity: int, linear: float, keep_ids: bool):
    """Full pieces of a group become sequences after those of the packed rests."""
    greedy = _packed(capacity, linear, keep_ids)

    def run(group: pa.Table) -> pa.Table:
        whole = pc.equal(group["length"], capacity)
        rest, full = group.filter(pc.invert(whole)), group.filter(whole)
        parts = []
        used = 0
        if rest.num_rows:
            parts.append(greedy(rest))
            used = -(-int(pc.sum(rest["length"]).as_py()) // capacity)
        if full.num_rows:
            full = full.sort_by([("doc_id", "ascending"), ("start", "ascending")])
            number = full["group"][0].as_py()
            ids = (number << 32) + used + np.arange(full.num_rows)
            parts.append(
                pa.Table.from_arrays(
                    [
                        full["doc_id"], full["start"], full["length"], full["ids_crc32"],
                        full["doc_tokens"], pa.array(ids, pa.int64()),
                        pa.array(np.zeros(full.num_rows, np.int64)),
                        full["ids"] if keep_ids else pa.nulls(full.num_rows, pa.binary()),
                    ],
                    parts[0].column_names if parts else [
                        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id",
                        "offset", "ids",
                    ],
                )
            )
        return pa.concat_tables(parts)

    return run
