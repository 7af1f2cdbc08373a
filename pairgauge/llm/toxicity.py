"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Fit. A bounded sample of labelled documents (``FIT_DOCUMENTS`` expected, chosen by a hash, whole texts)
gives document counts of words per label. Words that stand out in toxic documents label the tokens of
toxic documents; all other tokens are clean. The field has one weight per frequent word, a bias, two
starts and four moves, fitted by gradient steps on its conditional likelihood. A logistic curve then
turns what the marginals of a document add up to into a chance.

Score. Words are found and looked up on arrays, forward-backward runs over all texts of a slice
together, and words likely to be toxic join into spans of code points. Labels, language, source and id
are never read here.

Defined cases: a null or empty text has no tokens and gets the score that goes with none; repeated
rows are scored one by one; other columns are ignored; without toxic labels every score is the share of
toxic documents (0.5 without labels); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .chain import marginals
from .common import lean, picked, stored, takes_rows

#: Expected labelled documents that the fit reads, and the most words that get a weight.
FIT_DOCUMENTS = 6000
FIT_WORDS = 30_000
GRADIENT_STEPS = 25
SPAN_CHANCE = 0.5
THRESHOLD = 0.3


@dataclass
class Model:
    """Sorted word hashes with their weights, the field's potentials and the score curve."""

    keys: np.ndarray
    weights: np.ndarray
    bias: float = -4.0
    start: np.ndarray = field(default_factory=lambda: np.array([0.5, 0.5]))
    moves: np.ndarray = field(default_factory=lambda: np.full((2, 2), 0.5))
    curve: np.ndarray = field(default_factory=lambda: np.zeros(5))

    def emission(self, hashes: np.ndarray) -> np.ndarray:
        out = np.full(len(hashes), self.bias)
        if len(self.keys):
            place = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
            known = self.keys[place] == hashes
            out[known] += self.weights[place[known]]
        return out

    def score(self, features: np.ndarray) -> np.ndarray:
        z = self.curve[0] + features @ self.curve[1:]
        return 1.0 / (1.0 + np.exp(-np.clip(z, -35, 35)))


def _tokens(offsets: np.ndarray, data: np.ndarray):
    lowered = words.LOWER[data]
    owner, start, end = words.find(lowered, offsets, words.ALPHANUMERIC)
    return owner, start, end, words.hashes(lowered, start, end)


def document_features(owner: np.ndarray, chance: np.ndarray, count: int) -> np.ndarray:
    """Largest marginal, expected toxic words, their share, and length, each on a gentle scale."""
    largest = np.zeros(count)
    np.maximum.at(largest, owner, chance)
    expected = np.bincount(owner, weights=chance, minlength=count)
    n = np.bincount(owner, minlength=count)
    share = expected / np.maximum(n, 1)
    return np.stack([largest, np.log1p(expected), np.sqrt(share), np.log1p(n) / 10], 1)


def _word_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct words of each text with its label."""
    for batch in takes_rows(batches):
        offsets, data = words.utf8(batch.column(0))
        labels = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
        for low, high in words.slices(offsets, words.SMALL_SLICE):
            own = offsets[low : high + 1] - offsets[low]
            owner, _, _, h = _tokens(own, data[offsets[low] : offsets[high]])
            pair = np.unique(np.stack([owner.astype(np.uint64), h]), axis=1) if len(h) else None
            if pair is None:
                continue
            toxic = labels[low + pair[0].astype(np.int64)]
            word, place = np.unique(pair[1], return_inverse=True)
            bad = np.bincount(place, weights=toxic, minlength=len(word)).astype(np.int64)
            every = np.bincount(place, minlength=len(word)).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(word.view(np.int64)), pa.array(bad), pa.array(every - bad)],
                ["word", "bad", "good"],
            )


def _encoded(model_keys: np.ndarray):
    """Texts as feature numbers; 0 stands for a word without a weight."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in takes_rows(batches):
            offsets, data = words.utf8(batch.column(0))
            owner, _, _, h = _tokens(offsets, data)
            place = np.minimum(np.searchsorted(model_keys, h), len(model_keys) - 1)
            number = np.where(model_keys[place] == h, place + 1, 0).astype(np.uint16)
            each = np.bincount(owner, minlength=len(offsets) - 1)
            parts = np.split(number, np.cumsum(each)[:-1])
            yield pa.RecordBatch.from_arrays(
                [pa.array([p.tobytes() for p in parts], pa.binary()), batch.column(1)], ["ids", "toxic"]
            )

    return run


def _lexicon(bad: np.ndarray, good: np.ndarray, n_bad: int, n_good: int) -> np.ndarray:
    """Words whose share among toxic documents is surely several times that among clean ones."""
    odds = np.log((bad + 0.5) / (n_bad + 1)) - np.log((good + 0.5) / (n_good + 1))
    spread = np.sqrt(1 / (bad + 0.5) + 1 / (good + 0.5))
    return (odds - 1.0 * spread > np.log(2.0)) & (bad >= 3)


def _parts(begins: np.ndarray, most: int = 200_000) -> list[tuple[int, int]]:
    """Ranges of whole texts with about ``most`` tokens together."""
    first = np.flatnonzero(begins)
    cut = first[np.append(True, np.diff(first // most) > 0)] if len(first) else first
    return list(zip(cut.tolist(), [*cut[1:].tolist(), len(begins)], strict=True))


def _chances(model: Model, ids: np.ndarray, begins: np.ndarray) -> np.ndarray:
    weights = np.append(0.0, model.weights)
    out = np.zeros(len(ids))
    for a, b in _parts(begins):
        out[a:b], _ = marginals(weights[ids[a:b]] + model.bias, begins[a:b], model.start, model.moves)
    return out


def _fit_field(model: Model, ids: np.ndarray, begins: np.ndarray, tagged: np.ndarray) -> None:
    """Ascends the conditional likelihood of the tags; steps are scaled by each weight's own counts."""
    n = len(model.keys)
    weights = np.append(0.0, model.weights)
    known = np.bincount(ids, minlength=n + 1).astype(float)
    seen = np.bincount(ids, weights=tagged, minlength=n + 1)
    inner = ~begins[1:]
    moved = np.bincount(2 * tagged[:-1][inner] + tagged[1:][inner], minlength=4).reshape(2, 2) + 0.5
    begun = np.bincount(tagged[begins], minlength=2) + 0.5
    log_moves = np.log(moved / moved.sum(1, keepdims=True))
    log_start = np.log(begun / begun.sum())
    bias, parts = model.bias, _parts(begins)
    for _ in range(GRADIENT_STEPS):
        expected, curve = np.zeros(n + 1), np.zeros(n + 1)
        pairs, first = np.zeros((2, 2)), np.zeros(2) + 0.5
        for a, b in parts:
            own = ids[a:b]
            chance, moves = marginals(
                weights[own] + bias, begins[a:b], np.exp(log_start), np.exp(log_moves), pairs=True
            )
            expected += np.bincount(own, weights=chance, minlength=n + 1)
            curve += np.bincount(own, weights=chance * (1 - chance), minlength=n + 1)
            pairs += moves
            at = chance[begins[a:b]]
            first += [(1 - at).sum(), at.sum()]
        gradient = seen - expected - 0.3 * weights
        weights += np.clip(gradient / (curve + 0.3 + 0.002 * known), -1.5, 1.5) * 0.7
        weights[0] = 0.0
        bias += np.clip((seen.sum() - expected.sum()) / (curve.sum() + 1.0), -0.5, 0.5) * 0.3
        log_moves += 0.5 * np.clip((moved - pairs) / (moved + pairs + 1.0), -1, 1)
        log_start += 0.5 * np.clip((begun - first) / (begun + first), -1, 1)
    model.weights, model.bias = weights[1:], float(bias)
    model.moves, model.start = np.exp(log_moves), np.exp(log_start)


def _fit_curve(features: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton steps with a small ridge."""
    x = np.column_stack([np.ones(len(features)), features])
    beta = np.zeros(x.shape[1])
    ridge = np.diag([1e-3] + [0.05] * features.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -35, 35)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + ridge
        beta += np.linalg.solve(hessian, x.T @ (toxic - p) - ridge @ beta)
    return beta


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    documents: int = FIT_DOCUMENTS,
) -> Model:
    """A model of the labelled documents given; leave held-out rows out of ``labels``."""
    known = picked(labels, doc_id=id_col, toxic=label_col).where("doc_id IS NOT NULL AND toxic IN (0, 1)")
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    count = known.count()
    place = F.shiftrightunsigned(F.xxhash64("doc_id"), 11) / F.lit(float(1 << 53))
    few = stored(known.where(place < F.lit(documents / max(count, 1))))
    # The sample's size is bounded, so it goes to every task and no text is shuffled.
    texts = picked(docs, doc_id=id_col, text=text_col).join(F.broadcast(few), "doc_id")
    sample = stored(texts.select("text", "toxic"))
    totals = sample.agg(F.count("*"), F.sum("toxic")).first()
    n, n_bad = int(totals[0]), int(totals[1] or 0)
    empty = Model(np.zeros(0, np.uint64), np.zeros(0))
    if n_bad == 0 or n_bad == n:
        share = (n_bad + 0.5) / (n + 1)
        empty.curve[0] = np.log(share / (1 - share))
        return empty
    counted = sample.mapInArrow(lean(_word_documents), "word bigint, bad bigint, good bigint")
    counted = counted.groupBy("word").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    counted = counted.where("bad + good >= 3")
    table = counted.orderBy(F.desc(F.col("bad")), F.desc("good"), "word").limit(FIT_WORDS).toArrow()
    keys = table["word"].to_numpy().view(np.uint64)
    bad, good = table["bad"].to_numpy(), table["good"].to_numpy()
    order = np.argsort(keys)
    keys, bad, good = keys[order], bad[order], good[order]
    if len(keys) == 0:
        empty.curve[0] = np.log((n_bad + 0.5) / (n - n_bad + 0.5))
        return empty
    lexicon = np.append(False, _lexicon(bad, good, n_bad, n - n_bad))
    prior = np.log((bad + 0.5) / (n_bad + 1)) - np.log((good + 0.5) / (n - n_bad + 1))
    model = Model(keys, np.where(lexicon[1:], np.clip(prior, 0, 4), 0.0))
    rows = sample.mapInArrow(lean(_encoded(keys)), "ids binary, toxic int").toArrow()
    toxic = rows["toxic"].to_numpy().astype(float)
    size = pc.binary_length(rows["ids"]).to_numpy().astype(np.int64) // 2
    ids = np.frombuffer(b"".join(rows["ids"].to_pylist()), np.uint16)
    owner = np.repeat(np.arange(len(size), dtype=np.int32), size)
    begins = np.zeros(len(ids), bool)
    begins[(np.cumsum(size) - size)[size > 0]] = True
    tagged = (lexicon[ids] & (toxic[owner] > 0)).astype(np.int8)
    _fit_field(model, ids, begins, tagged)
    chance = _chances(model, ids, begins)
    model.curve = _fit_curve(document_features(owner, chance, len(size)), toxic)
    return model


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _spans(data: np.ndarray, own: np.ndarray, owner, start, end, chance, count: int) -> list[list[dict]]:
    """Neighbouring toxic words of a text joined; code points, end exclusive."""
    out: list[list[dict]] = [[] for _ in range(count)]
    toxic = np.flatnonzero(chance >= SPAN_CHANCE)
    if not len(toxic):
        return out
    points = np.append(0, np.cumsum((data & 0xC0) != 0x80))
    new = np.ones(len(toxic), bool)
    new[1:] = (np.diff(toxic) > 1) | (np.diff(owner[toxic]) > 0)
    first = toxic[new]
    last = toxic[np.append(np.flatnonzero(new)[1:], len(toxic)) - 1]
    for a, b in zip(first.tolist(), last.tolist(), strict=True):
        base = points[own[owner[a]]]
        out[owner[a]].append({"start": int(points[start[a]] - base), "end": int(points[end[b]] - base)})
    return out


def _scored(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in takes_rows(batches):
            offsets, data = words.utf8(batch.column(1))
            for low, high in words.slices(offsets, words.SMALL_SLICE):
                own = offsets[low : high + 1] - offsets[low]
                raw = data[offsets[low] : offsets[high]]
                owner, start, end, h = _tokens(own, raw)
                begins = np.ones(len(h), bool)
                begins[1:] = owner[1:] != owner[:-1]
                chance, _ = marginals(model.emission(h), begins, model.start, model.moves)
                score = model.score(document_features(owner, chance, high - low))
                spans = _spans(raw, own, owner, start, end, chance, high - low)
                expected = np.bincount(owner, weights=chance, minlength=high - low)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(low, high - low),
                        pa.array(score),
                        pa.array(expected.astype(float)),
                        pa.array(spans, _SPANS),
                    ],
                    ["doc_id", "score", "toxic_words", "spans"],
                )

    return run


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, expected toxic words and toxic spans of every document."""
    rows = picked(docs, doc_id=id_col, text=text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = (
        f"doc_id {kind}, score double, toxic_words double, "
        "spans array<struct<start: bigint, end: bigint>>"
    )
    return rows.mapInArrow(lean(_scored(model)), schema)


def clean(
    docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD
) -> DataFrame:
    """The documents scored below the threshold, with all their columns; no text is shuffled."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in takes_rows(batches):
            offsets, data = words.utf8(batch.column(at))
            for low, high in words.slices(offsets, words.SMALL_SLICE):
                own = offsets[low : high + 1] - offsets[low]
                owner, _, _, h = _tokens(own, data[offsets[low] : offsets[high]])
                begins = np.ones(len(h), bool)
                begins[1:] = owner[1:] != owner[:-1]
                chance, _ = marginals(model.emission(h), begins, model.start, model.moves)
                score = model.score(document_features(owner, chance, high - low))
                yield batch.slice(low, high - low).filter(pa.array(score < threshold))

    return docs.mapInArrow(lean(run), docs.schema)
