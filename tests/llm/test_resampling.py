"""Hashed importance resampling, against a plain version."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from pairgauge.llm import resampling

from . import plain


def _features(text, longest):
    words = plain.ALNUM_WORD.findall(plain.lowered(text))
    runs = [" ".join(words[i : i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1)]
    return len(words), runs


def plain_importance(docs, targets, longest=1, buckets=10_000, least=20, percent=10, seed=2024):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    own = [(i, *_features(t, longest)) for i, t in docs]
    s, t = Counter(), Counter()
    for _, _, runs in own:
        s.update(map(bucket, runs))
    for text in targets:
        t.update(map(bucket, _features(text, longest)[1]))
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = [
        math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets))))
        for b in range(buckets)
    ]
    rows = []
    for i, n, runs in own:
        weight = sum(gain[bucket(f)] for f in runs)
        name = "null" if i is None else i
        h = int(hashlib.sha256(f"{seed}:{name}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([i, len(runs), weight, score, None, n])
    fit = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, row in enumerate(fit[: percent * len(fit) // 100]):
        row[4] = k + 1
    return sorted((tuple(r[:5]) for r in rows), key=repr)


def _got(df):
    names = ("doc_id", "n_features", "weight", "score", "rank")
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


def test_crc_goes_on_from_a_state():
    rng = np.random.default_rng(1)
    texts = [bytes(rng.integers(0, 256, n)) for n in (0, 1, 2, 3, 7, 64, 255, 256, 5000)]
    for a in texts:
        for b in texts:
            got = resampling.joined(
                np.array([zlib.crc32(a)], np.uint32), np.array([zlib.crc32(b)], np.uint32), np.array([len(b)])
            )
            assert got[0] == zlib.crc32(a + b)


def _random(n, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(60)] + ["Ünï", "日本", "x" * 90, "don't", "A1"]
    return [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(60)))) for i in range(n)]


@pytest.mark.parametrize("longest, head, pairs", [(1, 65_536, 0), (1, 5, 0), (2, 30, 40), (3, 1, 1), (3, 500, 5000)])
def test_matches_the_plain_version(spark, monkeypatch, longest, head, pairs):
    """The size of the head never changes a value."""
    monkeypatch.setattr(resampling, "HEAD", head)
    monkeypatch.setattr(resampling, "HEAD_PAIRS", pairs)
    docs, targets = _random(300, 1), [t for _, t in _random(25, 2)]
    left = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5)
    right = spark.createDataFrame([(t,) for t in targets], "text string")
    got = resampling.importance(left, right, longest=longest, buckets=211, percent=30, seed=7)
    assert _got(got) == plain_importance(docs, targets, longest, 211, 20, 30, 7)


def test_odd_tables(spark, odd, none):
    docs = [(r.doc_id, r.text) for r in odd.collect()]
    targets = odd.select("text", "score", "kept")
    got = resampling.importance(odd, targets, percent=50)
    assert _got(got) == plain_importance(docs, [r.text for r in targets.collect()], percent=50)
    assert resampling.importance(none, targets).count() == 0
    alone = resampling.importance(odd, none, percent=100)
    assert _got(alone) == plain_importance(docs, [], percent=100)
    short = odd.where("doc_id < 8")
    assert resampling.importance(short, targets).where("rank IS NOT NULL").count() == 0


def test_drawn_documents_keep_their_columns(spark, odd):
    drawn = resampling.resampled(odd, odd.where("doc_id = 8"), percent=60)
    assert drawn.columns == odd.columns
    assert {r.doc_id for r in drawn.collect()} == {
        r[0] for r in plain_importance(
            [(r.doc_id, r.text) for r in odd.collect()], [odd.where("doc_id = 8").first().text], percent=60
        ) if r[4]
    }


def test_ranks_over_many_partitions(spark):
    rows = spark.range(5000).selectExpr("id AS doc_id", "id % 7 AS score").repartition(16)
    got = [(r.score, r.doc_id) for r in resampling._ranked(rows).orderBy("rank").collect()]
    assert got == sorted(got, key=lambda r: (-r[0], r[1]))
    assert [r["rank"] for r in resampling._ranked(rows).orderBy("rank").collect()] == list(range(1, 5001))
