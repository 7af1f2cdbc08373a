"""Repeated passages against a plain search for equal windows of words."""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pytest

from pairgauge.llm import chunks

WORD = re.compile("[^ \\t-\\r]+")


def _plain(rows, size):
    """(row, start, length, words, removable, first document) of every span."""
    holders, found = defaultdict(set), []
    for doc_id, text in rows:
        places = [m.span() for m in WORD.finditer(text or "")]
        found.append((doc_id, text, places))
        for k in range(len(places) - size + 1):
            holders[text[places[k][0] : places[k + size - 1][1]]].add(doc_id)
    out = []
    for row, (doc_id, text, places) in enumerate(found):
        held, free = set(), {}
        for k in range(len(places) - size + 1):
            own = holders[text[places[k][0] : places[k + size - 1][1]]]
            if len(own) > 1:
                held |= set(range(k, k + size))
                first = min(x for x in own if x is not None)
                if doc_id != first:
                    for w in range(k, k + size):
                        free[w] = min(first, free.get(w, first))
        for w in sorted(held):
            if w - 1 in held:
                continue
            last = w
            while last + 1 in held:
                last += 1
            span = range(w, last + 1)
            removable = sum((places[v + 1][0] if v < last and v + 1 in free else places[v][1]) - places[v][0] for v in span if v in free)
            firsts = [free[v] for v in span if v in free]
            out.append((doc_id, places[w][0], places[last][1] - places[w][0], len(span), removable, min(firsts, default=None)))
    return out


def _got(df, **more):
    rows = chunks.repeats(df, **more).collect()
    return [(r.doc_id, r.start, r.length, r.n_words, r.removable, r.first_doc) for r in rows]


def _sorted(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x or 0) for x in r))


@pytest.mark.parametrize("block_bytes", [1 << 12, chunks.BLOCK_BYTES])
def test_every_common_passage_is_a_span(spark, block_bytes):
    """600 passages of 20 to 100 words, each in two documents; chunks alone missed 4 in 100 of 51 words."""
    rng = np.random.default_rng(8)
    vocabulary = ["".join(chr(97 + c) for c in rng.integers(0, 26, n)) for n in rng.integers(1, 9, 3000)]
    draw = lambda n: " ".join(vocabulary[k] for k in rng.integers(0, 3000, n))
    rows = []
    for k in range(600):
        passage = draw(int(rng.choice([20, 51, 55, 60, 75, 100])))
        rows += [(2 * k, f"{draw(30)} {passage} {draw(9)}"), (2 * k + 1, f"\u00e9 {draw(k % 40)}\n{passage}\t{draw(20)}")]
    spans = _got(spark.createDataFrame(rows, "doc_id bigint, text string"), block_bytes=block_bytes)
    assert _sorted(spans) == _sorted(_plain(rows, chunks.MIN_WORDS))
    assert {r[0] for r in spans} == set(range(1200))


@pytest.mark.parametrize("size", [1, 5, 20])
def test_spans_of_odd_rows_are_the_plain_ones(spark, odd, size):
    """Ids that repeat or are missing, texts of one repeated word, and passages next to each other."""
    lines = [" ".join(f"l{k}w{j}" for j in range(24)) for k in range(4)]
    rows = [
        (1, "a " * 70), (2, "a " * 50 + "b"), (2, lines[0]), (2, f"x {lines[0]}"), (None, lines[1]), (None, lines[1]),
        (3, f"{lines[2]} {lines[3]}"), (4, f"{lines[3]} {lines[2]}"), (None, lines[2]), (5, None), (6, ""), (0, f"{lines[3]} a a"),
    ]
    rows += [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect() if len(r.text or "") < 1000]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert _sorted(_got(df, min_words=size, block_bytes=200)) == _sorted(_plain(rows, size))


def test_many_equal_rows_do_not_meet_in_one_block(spark):
    text = " ".join(f"w{k}" for k in range(400))
    df = spark.createDataFrame([(7, text)] * 200 + [(8, text)], "doc_id bigint, text string")
    assert _sorted(_got(df, block_bytes=1 << 14)) == [(7, 0, len(text), 400, 0, None)] * 200 + [(8, 0, len(text), 400, len(text), 7)]
