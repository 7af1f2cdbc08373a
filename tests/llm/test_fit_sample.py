"""The field is fitted on all labelled documents where they are not more than it may read."""

from __future__ import annotations

import numpy as np

from pairgauge.llm import toxicity


def test_rare_words_of_5000_documents_get_weights(spark):
    """Each rare word is in three toxic documents of 5,000; a sample of 3,000 lost most of them."""
    rows = [(k, f"plain words here rare{k // 15}q" if k % 5 == 0 and k < 900 else f"plain words here n{k}", int(k % 5 == 0)) for k in range(5000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    model = toxicity.fit(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    texts = [f"rare{k}q".encode() for k in range(60)]
    offsets = np.append(0, np.cumsum([len(t) for t in texts]))
    _, _, _, hashes = toxicity._tokens(offsets, np.frombuffer(b"".join(texts), np.uint8))
    assert np.isin(hashes, model.keys).all()
