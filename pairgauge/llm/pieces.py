"""Encoding with a sentencepiece model that keeps the place of every piece in the original bytes.

Normalisation comes first and records its source. The model's compiled character map is a double-array
trie of byte strings and their replacements; at each place the longest key that fits is replaced, other
characters stay, and bytes that are no UTF-8 become U+FFFD one by one. Every normalised byte carries the
place of the original character it came from. Only bytes that can begin a key (by a table of byte pairs)
walk the trie; all the rest is copied as arrays. The model's blank rules follow on the same arrays.

The library then segments normalised text, with its own normaliser switched off. In a byte-pair model a
place where no piece of the vocabulary has the two characters side by side can never be inside a piece, so
text is cut there and equal parts are encoded once (a cache of bounded size that compares 128 bits). Pieces cover the normalised bytes
without gaps, so their lengths give normalised spans, and the recorded sources turn these into spans of
original bytes. A character that falls back to bytes has its whole span on the last of them.

Defined cases: a null or empty text has the begin and end ids alone and decodes to an empty text; very long
texts are encoded part by part; repeated rows are encoded one by one; other columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .common import picked, takes_rows

CACHE_PARTS = 600_000
CACHE_BYTES = 64

_NORMAL, _UNKNOWN, _CONTROL, _DEFINED, _UNUSED, _BYTE = range(1, 7)
_BPE = 2
_FOREIGN, _KNOWN, _BLANK = range(3)
_MARK = "▁"
_REPLACEMENT = "�".encode()


def fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protocol-buffer message."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = message[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value, at
            shift += 7

    at = 0
    while at < len(message):
        tag, at = varint(at)
        kind = tag & 7
        if kind == 0:
            value, at = varint(at)
        else:
            size = {1: 8, 5: 4}.get(kind)
            if size is None:
                size, at = varint(at)
            value = message[at : at + size]
            at += size
        yield tag >> 3, value


def _message(number: int, content: bytes) -> bytes:
    size, out = len(content), bytearray([number << 3 | 2])
    while size > 127:
        out.append(size & 127 | 128)
        size >>= 7
    return bytes(out) + bytes([size]) + content


class CharacterMap:
    """Longest-prefix replacement through the compiled map of a model."""

    def __init__(self, compiled: bytes) -> None:
        self.units = np.zeros(0, np.uint32)
        self.begins = np.zeros(256, bool)
        self.pairs = np.zeros((256, 256), bool)
        if not compiled:
            return
        size = int.from_bytes(compiled[:4], "little")
        self.units = np.frombuffer(compiled[4 : 4 + size], "<u4")
        self.texts = compiled[4 + size :]
        self.walk = self.units.tolist()
        root = self._below(0)
        for first in self._children(root):
            node = root ^ first
            self.begins[first] = True
            below = self._below(node)
            # A key of one byte fits before any byte.
            self.pairs[first, :] = bool(self.walk[node] >> 8 & 1)
            self.pairs[first, self._children(below)] = True

    def _below(self, node: int) -> int:
        unit = self.walk[node]
        return node ^ ((unit >> 10) << ((unit & 512) >> 6))

    def _children(self, below: int) -> list[int]:
        places = below ^ np.arange(256)
        inside = places < len(self.units)
        label = self.units[np.where(inside, places, 0)] & np.uint32(0x800000FF)
        fits = inside & (label == np.arange(256))
        fits[0] = False
        return np.flatnonzero(fits).tolist()

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length and replacement of the longest key at a place."""
        walk, found = self.walk, None
        node = self._below(0)
        for k in range(at, len(data)):
            byte = data[k]
            node ^= byte
            if byte == 0 or node >= len(walk):
                break
            unit = walk[node]
            if unit & 0x800000FF != byte:
                break
            below = node ^ ((unit >> 10) << ((unit & 512) >> 6))
            if unit >> 8 & 1:
                found = k + 1 - at, walk[below] & 0x7FFFFFFF
            node = below
        if found is None:
            return None
        size, place = found
        return size, self.texts[place : self.texts.index(b"\0", place)]

    def candidates(self, data: np.ndarray) -> np.ndarray:
        """Places of whole characters at which a key may begin."""
        if not len(self.units) or not len(data):
            return np.zeros(0, np.int64)
        after = np.append(data[1:], np.uint8(0))
        fits = self.begins[data] & self.pairs[data, after] & ((data & 0xC0) != 0x80)
        return np.flatnonzero(fits)


def _bad_bytes(raw: bytes) -> np.ndarray:
    """Places of bytes that are no part of valid UTF-8."""
    found: list[int] = []
    at = 0
    while True:
        try:
            raw[at:].decode()
            return np.array(found, np.int64)
        except UnicodeDecodeError as e:
            found.extend(range(at + e.start, at + e.end))
            at += e.end


class Normaliser:
    """Normalised bytes of a text, and the original place of each of them and of the end."""

    def __init__(
        self,
        compiled: bytes = b"",
        prefix: bool = True,
        squeeze: bool = True,
        escape: bool = True,
        at_end: bool = False,
        symbols: tuple[bytes, ...] = (),
    ) -> None:
        self.map = CharacterMap(compiled)
        self.prefix, self.squeeze, self.escape, self.at_end = prefix, squeeze, escape, at_end
        self.symbols = None
        if symbols:
            longest_first = sorted(symbols, key=len, reverse=True)
            self.symbols = re.compile(b"|".join(map(re.escape, longest_first)))

    def _replaced(self, raw: bytes, data: np.ndarray):
        """(start, end, replacement) of what isn't copied, from left to right."""
        at = [self.map.candidates(data)]
        bad: set[int] = set()
        try:
            raw.decode()
        except UnicodeDecodeError:
            places = _bad_bytes(raw)
            bad = set(places.tolist())
            at.append(places)
        marks = {}
        if self.symbols is not None:
            for m in self.symbols.finditer(raw):
                marks[m.start()] = m.end()
            at.append(np.array(list(marks), np.int64))
        order = np.unique(np.concatenate(at)) if len(at) > 1 else at[0]
        done = 0
        for place in order.tolist():
            if place < done:
                continue
            if place in marks:
                done = marks[place]
                yield place, done, raw[place:done]
                continue
            key = self.map.longest(raw, place) if len(self.map.units) else None
            if key is not None:
                done = place + key[0]
                yield place, done, key[1]
            elif place in bad:
                done = place + 1
                yield place, done, _REPLACEMENT

    def __call__(self, raw: bytes) -> tuple[bytes, np.ndarray]:
        data = np.frombuffer(raw, np.uint8)
        n = len(data)
        # Every byte of a character comes from the character's first byte.
        first = np.where((data & 0xC0) != 0x80, np.arange(n), 0)
        source = np.maximum.accumulate(first) if n else first
        lead = data == 32
        unit = source
        swapped = list(self._replaced(raw, data))
        if swapped:
            parts, sources, leads, units, at, size = [], [], [], [], 0, 0

            def copy(a: int, b: int) -> None:
                nonlocal size
                parts.append(data[a:b])
                sources.append(source[a:b])
                leads.append(lead[a:b])
                units.append(source[a:b] - a + size)
                size += b - a

            for a, b, new in swapped:
                copy(at, a)
                content = np.frombuffer(new, np.uint8)
                parts.append(content)
                sources.append(np.full(len(content), a, np.int64))
                leads.append(np.arange(len(content)) < len(new) - len(new.lstrip(b" ")))
                units.append(np.full(len(content), size, np.int64))
                size += len(content)
                at = b
            copy(at, n)
            data, source, lead, unit = map(np.concatenate, (parts, sources, leads, units))
        end = n
        begin = 0
        if self.squeeze and len(data):
            blank = data == 32
            before = np.append(True, blank[:-1])
            kept = np.flatnonzero(~(lead & before[unit]))
            if not len(kept):
                return b"", np.zeros(1, np.int64)
            begin = int(source[kept[0]])
            data, source = data[kept], source[kept]
        elif n == 0:
            return b"", np.zeros(1, np.int64)
        space = np.full(1, 32, np.uint8)
        if self.prefix and not self.at_end:
            data, source = np.append(space, data), np.append(begin, source)
        mark = _MARK.encode() if self.escape else b" "
        text = data.tobytes().replace(b" ", mark)
        if self.escape:
            source = np.repeat(source, np.where(data == 32, 3, 1))
        if self.squeeze:
            # Blanks at the end go, signs that look like escaped ones too; the text ends where they began.
            size = len(text)
            while text.endswith(mark, 0, size):
                size -= len(mark)
            if size < len(text):
                end = int(source[size])
                text, source = text[:size], source[:size]
        if self.prefix and self.at_end:
            text, source = text + mark, np.append(source, np.full(len(mark), end))
        return text, np.append(source, end)


class Encoder:
    """Ids and original spans of texts by a sentencepiece model; ``model`` is the content of its file."""

    def __init__(self, model: bytes) -> None:
        from sentencepiece import SentencePieceProcessor

        kept, train, rules, pieces = [], {}, {}, []
        for number, value in fields(model):
            if number == 3:
                rules = dict(fields(value))
                continue
            if number == 1:
                piece = dict(fields(value))
                pieces.append((piece[1].decode(), piece.get(3, _NORMAL)))
            if number == 2:
                train = dict(fields(value))
            if number != 5:
                kept.append(_message(number, value))
        plain = _message(1, b"identity") + b"\x18\x00\x20\x00\x28\x00"
        self.core = SentencePieceProcessor(model_proto=b"".join(kept) + _message(3, plain))
        self.library = SentencePieceProcessor(model_proto=model)
        defined = tuple(p.encode() for p, kind in pieces if kind == _DEFINED)
        self.normalise = Normaliser(
            rules.get(2, b""), bool(rules.get(3, 1)), bool(rules.get(4, 1)), bool(rules.get(5, 1)),
            bool(train.get(24, 0)), defined,
        )
        # Bytes of each piece; what the unknown id covers is asked for when it occurs.
        self.size = np.array(
            [1 if kind == _BYTE else len(p.encode()) for p, kind in pieces], np.int64
        )
        self.unknown = self.library.unk_id()
        self.begin, self.end = self.library.bos_id(), self.library.eos_id()
        self.kinds = np.full(0x110000, _FOREIGN, np.uint8)
        self.cut = train.get(3, 1) == _BPE
        if self.cut:
            own = [p for p, kind in pieces if kind in (_NORMAL, _DEFINED, _UNUSED)]
            self.kinds[[ord(c) for c in set("".join(own))]] = _KNOWN
            if not any(_MARK in p.lstrip(_MARK) for p in own):
                self.kinds[ord(_MARK)] = _BLANK
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.checks = np.zeros(0, np.uint64)
        self.first = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int32)
        self.covers = np.zeros(0, np.int32)

    def _starts(self, data: np.ndarray, text: str, offsets: np.ndarray) -> np.ndarray:
        """First bytes of parts: texts begin, blanks after others, characters that no piece has."""
        begins = np.zeros(len(data) + 1, bool)
        begins[offsets] = True
        if self.cut:
            kind = self.kinds[np.frombuffer(text.encode("utf-32-le"), np.uint32)]
            change = kind == _FOREIGN
            change[1:] |= change[:-1].copy()
            change[1:] |= (kind[1:] == _BLANK) & (kind[:-1] != _BLANK)
            begins[np.flatnonzero((data & 0xC0) != 0x80)[change]] = True
        return np.flatnonzero(begins[:-1])

    def _asked(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of parts by the library, laid end to end, the bytes each covers, and ids per part."""
        found = self.core.encode(parts, num_threads=1)
        count = np.array([len(f) for f in found], np.int64)
        ids = np.fromiter(chain.from_iterable(found), np.int32, int(count.sum()))
        covers = self.size[ids]
        if self.unknown in ids:
            first = np.cumsum(count) - count
            for k in np.unique(np.repeat(np.arange(len(parts)), count)[ids == self.unknown]).tolist():
                pieces = self.core.encode(parts[k], return_type="proto").pieces
                covers[first[k] : first[k] + count[k]] = [len(p.surface.encode()) for p in pieces]
        return ids, covers, count

    def _segmented(self, data: np.ndarray, offsets: np.ndarray):
        """Ids of normalised texts laid end to end, bytes each covers, and ids per text."""
        content = data.tobytes()
        start = self._starts(data, content.decode(), offsets)
        end = np.append(start[1:], len(data))
        owner = np.searchsorted(offsets, start, side="right") - 1
        keys, at, inverse = np.unique(words.hashes(data, start, end), return_index=True, return_inverse=True)
        checks = words.hashes(data, start[at], end[at], again=True)
        place = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        hit = np.zeros(len(keys), bool)
        if len(self.keys):
            hit = (self.keys[place] == keys) & (self.checks[place] == checks)
        first, count = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        first[hit], count[hit] = self.first[place[hit]], self.count[place[hit]]
        new = np.flatnonzero(~hit)
        parts = [content[a:b].decode() for a, b in zip(start[at[new]], end[at[new]], strict=True)]
        ids, covers, count[new] = self._asked(parts) if parts else (self.ids[:0], self.covers[:0], 0)
        first[new] = np.cumsum(count[new]) - count[new]
        each = count[inverse]
        source = np.repeat(first[inverse], each) + words.runs(each)
        stored = np.repeat(hit[inverse], each)
        out = np.empty((2, len(source)), np.int32)
        for row, old, asked in ((0, self.ids, ids), (1, self.covers, covers)):
            out[row, stored] = old[source[stored]]
            out[row, ~stored] = asked[source[~stored]]
        self._learn(new, keys, checks, end[at] - start[at], first, count, ids, covers)
        texts = np.bincount(owner, weights=each, minlength=len(offsets) - 1).astype(np.int64)
        return out[0], out[1], texts

    def _learn(self, new, keys, checks, size, first, count, ids, covers) -> None:
        """Keep short new parts; a part whose key is there with another check stays unknown."""
        if len(self.keys) + len(new) > CACHE_PARTS:
            self._clear()
        short = new[size[new] <= CACHE_BYTES]
        if not len(short):
            return
        each = count[short]
        source = np.repeat(first[short], each) + words.runs(each)
        place = np.searchsorted(self.keys, keys[short])
        begin = len(self.ids) + np.cumsum(each) - each
        self.keys = np.insert(self.keys, place, keys[short])
        self.checks = np.insert(self.checks, place, checks[short])
        self.first = np.insert(self.first, place, begin)
        self.count = np.insert(self.count, place, each)
        self.ids = np.concatenate([self.ids, ids[source]])
        self.covers = np.concatenate([self.covers, covers[source]])

    def _windows(self, normal: list[bytes]) -> Iterator[tuple[int, bytes]]:
        """Texts, the long ones cut before a blank every SLICE_BYTES or so."""
        blank = _MARK.encode()
        for k, text in enumerate(normal):
            at = 0
            while self.cut and self.kinds[ord(_MARK)] == _BLANK and len(text) - at > 2 * words.SLICE_BYTES:
                to = text.find(blank, at + words.SLICE_BYTES)
                while to > 0 and text[to - 3 : to] == blank:
                    to = text.find(blank, to + 3)
                if to < 0:
                    break
                yield k, text[at:to]
                at = to
            yield k, text[at:]

    def encode(self, raws: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each text its ids with begin and end, first original byte and end byte of each."""
        normal = [self.normalise(raw) for raw in raws]
        found: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in raws]
        held: list[tuple[int, bytes]] = []

        def settle() -> None:
            offsets = np.cumsum([0, *(len(t) for _, t in held)])
            data = np.frombuffer(b"".join(t for _, t in held), np.uint8)
            ids, covers, each = self._segmented(data, offsets)
            to = np.cumsum(each)
            for (k, _), a, b in zip(held, to - each, to, strict=True):
                found[k].append((ids[a:b], covers[a:b]))
            held.clear()

        size = 0
        for k, text in self._windows([n for n, _ in normal]):
            held.append((k, text))
            size += len(text)
            if size >= words.SLICE_BYTES:
                settle()
                size = 0
        if held:
            settle()
        for raw, (text, source), own in zip(raws, normal, found, strict=True):
            ids = np.concatenate([i for i, _ in own])
            covers = np.concatenate([c for _, c in own]).astype(np.int64)
            to = np.cumsum(covers)
            if (to[-1] if len(to) else 0) != len(text):
                raise ValueError("pieces don't cover the normalised text")
            yield (
                np.concatenate([[self.begin], ids, [self.end]]).astype(np.int32),
                np.concatenate([[0], source[to - covers], [len(raw)]]),
                np.concatenate([[0], source[to], [len(raw)]]),
            )

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids)


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, list[bytes]]]:
    """Ids and texts of a batch, about SLICE_BYTES at a time; null counts as empty."""
    column = batch.column("text")
    offsets = np.append(0, np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)))
    for low, high in words.slices(offsets):
        yield batch.column("doc_id").slice(low, high - low), [v or b"" for v in column.slice(low, high - low).to_pylist()]


def _encoded(model: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(model)
        for batch in takes_rows(batches):
            for names, raws in _texts(batch):
                ids, start, end = zip(*encoder.encode(raws), strict=True)
                yield pa.RecordBatch.from_arrays(
                    [
                        names,
                        pa.array(ids, pa.list_(pa.int32())),
                        pa.array(start, pa.list_(pa.int64())),
                        pa.array(end, pa.list_(pa.int64())),
                    ],
                    ["doc_id", "ids", "starts", "ends"],
                )

    return run


def _decoded(model: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(model)
        for batch in takes_rows(batches):
            texts = [encoder.decode(ids or []) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"]
            )

    return run


def _digested(model: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(model)
        hexed = lambda content: hashlib.sha256(content).hexdigest()
        for batch in takes_rows(batches):
            for names, raws in _texts(batch):
                rows = [
                    (
                        len(ids),
                        hexed(ids.astype("<u4").tobytes()),
                        hexed(encoder.decode(ids.tolist()).encode()),
                        hexed(np.stack([start, end], 1).astype("<u4").tobytes()),
                    )
                    for ids, start, end in encoder.encode(raws)
                ]
                n, *digests = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [names, pa.array(n, pa.int64()), *(pa.array(d, pa.string()) for d in digests)],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256"],
                )

    return run


def _model(path: str) -> bytes:
    """The model file goes along with the tasks; it is a vocabulary, not data."""
    with open(path, "rb") as file:
        return file.read()


def _rows(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    rows = picked(docs, doc_id=id_col, text=text_col)
    rows = rows.select("doc_id", F.col("text").cast("binary").alias("text"))
    return rows, rows.schema["doc_id"].dataType.simpleString()


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, starts, ends): ids with begin and end, and their spans in the text's UTF-8 bytes."""
    rows, kind = _rows(docs, id_col, text_col)
    schema = f"doc_id {kind}, ids array<int>, starts array<bigint>, ends array<bigint>"
    return rows.mapInArrow(_encoded(_model(path)), schema)


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) from ids; a null list decodes to an empty text."""
    rows = picked(encoded, doc_id=id_col, ids=ids_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_decoded(_model(path)), f"doc_id {kind}, text string")


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Number of ids and digests of ids, decoded text and spans (pairs of 32-bit begin and end)."""
    rows, kind = _rows(docs, id_col, text_col)
    schema = f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string, spans_sha256 string"
    return rows.mapInArrow(_digested(_model(path)), schema)
