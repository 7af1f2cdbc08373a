"""Frequent contexts of the Katz model: split over buckets, with the scores of the whole model."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pairgauge.llm import common, katz

from . import plain
from .conftest import SF


@pytest.mark.parametrize("piece", [20, 1000])
def test_split_contexts_give_the_same_scores(spark, documents, piece):
    model = plain.Katz({i: t for i, (t, _) in documents.items()}, katz.discounts)
    learned = F.expr("crc32(CAST(doc_id AS STRING)) % 5 <> 1")
    rows = katz.katz_scores(common.read(spark, SF, "documents"), learned, block_bytes=100_000, piece=piece).collect()
    assert len(rows) == len(documents)
    for r in rows:
        assert r.score == pytest.approx(model.score(r.doc_id), rel=1e-9)


def _by_bucket(table: pa.Table):
    for bucket in sorted(set(table["bucket"].to_pylist())):
        yield table.filter(pa.compute.equal(table["bucket"], bucket))


def test_no_bucket_holds_all_pairs_of_a_frequent_word():
    """Every second word is the same one, followed by words that differ; documents begin with all words."""
    buckets, piece, blocks, answers = 16, 200, [], []
    for k in range(8):
        texts = [f"v{k}x{j} " + " ".join(f"the v{k}x{j}x{i}" for i in range(10)) for j in range(100)]
        batch = pa.RecordBatch.from_arrays(
            [pa.array([k] * 100, pa.int32()), pa.array(range(100)), pa.array([True] * 100), pa.array(texts)],
            ["block", "doc_id", "train", "text"],
        )
        blocks.append(pa.Table.from_batches(list(katz._blobs(8)(iter([batch])))))
    asked = pa.concat_tables([katz._ask_words(buckets)(b) for b in blocks])
    answers = pa.concat_tables([katz._answer_words(buckets, piece)(t) for t in _by_bucket(asked)])
    starts = 800 // piece
    mine = [answers.filter(pa.compute.equal(answers["block"], k)) for k in range(8)]
    pairs = pa.concat_tables([katz._ask_pairs(buckets, starts)(b, t) for b, t in zip(blocks, mine, strict=True)])
    sizes = [sum(len(katz.unpacked(x, np.int32)) for x in t["c"].to_pylist()) for t in _by_bucket(pairs)]
    # 8000 pairs begin with "the" and about as many with other words.
    assert sum(sizes) > 16_000 and max(sizes) < 2.5 * sum(sizes) / buckets
