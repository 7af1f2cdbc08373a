"""Every stage against a plain version of what it decides."""

from __future__ import annotations

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from pairgauge.llm import common, toxicity

from . import plain
from .conftest import SF
from .test_texts import _check_mix, _check_packing


def test_stages_one_by_one(spark):
    docs = common.read(spark, SF, "documents")
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)
    names = list(stages)

    safe = common.stored(stages[names[0]](spark, docs, SF))
    model = toxicity.fit(docs, common.read(spark, SF, "labels"))
    score = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert {r.doc_id for r in safe.collect()} == {i for i, s in score.items() if s < corpus_pipeline.REJECT}

    single = common.stored(stages[names[1]](spark, safe, SF))
    sets = {r.doc_id: plain.shingle_set(r.text, 5) for r in safe.collect()}
    classes = plain.components(sets, plain.near_links(sets))
    assert sorted(r.doc_id for r in single.collect()) == sorted(set(classes.values()))

    clean = common.stored(stages[names[2]](spark, single, SF))
    before = {r.doc_id: r.text for r in single.collect()}
    for r in clean.collect():
        assert r.n_chars == len(r.text)
        spans = plain.base_spans(before[r.doc_id])
        assert (r.text == before[r.doc_id]) or "[" in r.text
        assert not spans or not any(before[r.doc_id][a:b] in r.text for a, _, b in spans)

    mix = common.stored(stages[names[3]](spark, clean, SF))
    assert safe.columns == single.columns == clean.columns == mix.columns == columns
    sizes, own = {}, {}
    for r in clean.collect():
        own[r.doc_id] = (r.source, len(plain.BLANK_WORD.findall(r.text)))
        sizes[r.source] = sizes.get(r.source, 0) + own[r.doc_id][1]
    taken = dict.fromkeys(sizes, 0)
    for r in mix.collect():
        taken[r.source] += own[r.doc_id][1]
    from pairgauge.llm import mixing

    rows = mixing.mix(clean).collect()
    _check_mix(rows, sizes)
    want = dict.fromkeys(sizes, 0)
    for r in rows:
        want[r.source] += r.taken
    assert taken == want

    texts: dict = {}
    for r in mix.collect():
        texts.setdefault(r.doc_id, []).append(r.text)
    pieces = stages[names[4]](spark, mix, SF).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.TOKENIZER))
    assert _check_packing(pieces, texts, tokenizer) > 0.98


def test_run_reaches_the_end(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_empty_table(spark, none, tmp_path):
    rows = none.select("doc_id", "text", "lang", "source", "n_chars")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = rows
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
    assert docs.count() == 0
