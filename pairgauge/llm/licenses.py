"""Licence scan: base phrases by consecutive words, and ordered signature rules.

A keyword automaton reads each whole text once and names the rules worth trying. Of the matches, one
whose span lies inside a kept span of at least its priority is suppressed. Nothing is shuffled.

Defined cases: a null or empty text has no words, no labels and score 0; repeated rows are scanned
one by one; other columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import words
from .common import picked, takes_rows
from .license_rules import Rule, build

#: Words of a phrase and the label it stands for.
PHRASES: tuple[tuple[tuple[bytes, ...], str], ...] = (
    ((b"under", b"the", b"mit", b"license"), "mit"),
    ((b"apache", b"license", b"version", b"2"), "apache-2"),
    ((b"cc", b"by", b"nc"), "cc-by-nc"),
)
BASE_CONFIDENCE = 0.95
_GAP = rb"[\x00-\x2f\x3a-\x60\x7b-\x7f]+"
_WORD = rb"[0-9a-z\x80-\xff]"

SCHEMA = (
    "doc_id {id}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, "
    "base_labels string, labels string, score double, "
    "spans array<struct<start: bigint, end: bigint, label: string, rule: string>>"
)


@cache
def _machinery():
    rules = build()
    by_key: dict[str, list[int]] = {}
    for k, rule in enumerate(rules):
        for key in rule.keywords:
            by_key.setdefault(key, []).append(k)
    automaton = ahocorasick.Automaton()
    for key, owners in by_key.items():
        automaton.add_word(key, owners)
    automaton.make_automaton()
    phrases = [
        (
            phrase[0],
            re.compile(rb"(?<!" + _WORD + rb")" + _GAP.join(phrase) + rb"(?!" + _WORD + rb")"),
            label,
        )
        for phrase, label in PHRASES
    ]
    return rules, automaton, phrases


def keep_outer(found: list[tuple[int, int, Rule]]) -> list[tuple[int, int, Rule]]:
    """Matches left once spans contained in a kept one of at least their priority are suppressed."""
    kept: list[tuple[int, int, Rule]] = []
    order = sorted(found, key=lambda m: (-m[2].priority, m[0] - m[1], m[0], m[2].label))
    for start, end, rule in order:
        if not any(a <= start and end <= b for a, b, _ in kept):
            kept.append((start, end, rule))
    return sorted(kept, key=lambda m: (m[0], m[1], m[2].label))


def signatures(lowered: str) -> list[tuple[int, int, Rule]]:
    """The method's matches in one text whose A-Z are lower-cased; code points, end exclusive."""
    rules, automaton, _ = _machinery()
    wanted: set[int] = set()
    for _, owners in automaton.iter(lowered):
        wanted.update(owners)
    found = [
        (m.start(), m.end(), rules[k]) for k in sorted(wanted) for m in rules[k].regex.finditer(lowered)
    ]
    return keep_outer(found)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    _, _, phrases = _machinery()
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
    for batch in takes_rows(batches):
        offsets, data = words.utf8(batch.column(1))
        for low, high in words.slices(offsets):
            own = offsets[low : high + 1] - offsets[low]
            lowered = words.LOWER[data[offsets[low] : offsets[high]]]
            _, start, _ = words.find(lowered, own, words.ALPHANUMERIC)
            first = np.searchsorted(start, own)
            raw = lowered.tobytes()
            rows: dict[str, list] = {name: [] for name in names}
            for k in range(high - low):
                text = raw[own[k] : own[k + 1]]
                places, base = [], set()
                for key, regex, label in phrases:
                    if key in text:
                        for m in regex.finditer(text):
                            places.append(int(np.searchsorted(start, own[k] + m.start()) - first[k]))
                            base.add(label)
                spans = signatures(text.decode("utf-8", "replace"))
                sure = [r.confidence for _, _, r in spans] + [BASE_CONFIDENCE] * bool(base)
                every = sorted(base | {r.label for _, _, r in spans})
                values = (
                    int(first[k + 1] - first[k]),
                    len(places),
                    min(places, default=None),
                    max(places, default=None),
                    ",".join(sorted(base)),
                    ",".join(every),
                    float(max(sure, default=0.0)),
                    [
                        {"start": a, "end": b, "label": r.label, "rule": r.form} for a, b, r in spans
                    ],
                )
                for name, value in zip(names, values, strict=True):
                    rows[name].append(value)
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), _SPANS]
            arrays = [pa.array(rows[n], type=t) for n, t in zip(names, kinds, strict=True)]
            ids = batch.column(0).slice(low, high - low)
            yield pa.RecordBatch.from_arrays([ids, *arrays], ["doc_id", *names])


_SPANS = pa.list_(
    pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("rule", pa.string())])
)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, base places, labels, confidence and matched spans of every document."""
    rows = picked(docs, doc_id=id_col, text=text_col)
    return rows.mapInArrow(_scan, SCHEMA.format(id=rows.schema["doc_id"].dataType.simpleString()))
