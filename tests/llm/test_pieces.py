"""Encoding with original spans, against the library itself."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from sentencepiece import SentencePieceNormalizer, SentencePieceProcessor

from pairgauge.llm import common, pieces, queries, words

from .conftest import ODD_TEXTS, SF

MODEL = public_tokenizers.path("piece_bpe_32k.model")
PARTS = [
    "a", "b", " ", "  ", "▁", "\n", "\t", "é", "é", "日本", "𝔘", "\x00", "the", "ing", "​", "ﬁ", "①",
    "word ", " <s> ", "<0x41>", "ab▁c", "　", "ﷺ", "가", "Å",
]


def _texts(n: int, seed: int) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randrange(40))) for _ in range(n)]


@pytest.fixture(scope="module")
def library():
    return SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def model():
    with open(MODEL, "rb") as file:
        return file.read()


def _same(encoder, library, texts):
    raws = [t.encode() for t in texts]
    for text, raw, (ids, start, end) in zip(texts, raws, encoder.encode(raws), strict=True):
        assert ids.tolist() == library.encode(text, add_bos=True, add_eos=True), text[:80]
        want = [(p.begin, p.end) for p in library.encode(text, return_type="proto").pieces]
        assert list(zip(start[1:-1].tolist(), end[1:-1].tolist(), strict=True)) == want, text[:80]
        # Spans follow each other and cover the text.
        assert (start[1:] >= start[:-1]).all() and (not raw or end[-2] == len(raw))
        assert (start[0], end[0], start[-1], end[-1]) == (0, 0, len(raw), len(raw))


def test_ids_and_spans(model, library, documents):
    encoder = pieces.Encoder(model)
    _same(encoder, library, [t for t, _ in documents.values()])
    _same(encoder, library, _texts(1500, 1) + ["", " ", "▁" * 40, "x" * 3000])


def test_windows_and_full_cache_change_nothing(model, library, documents, monkeypatch):
    monkeypatch.setattr(words, "SLICE_BYTES", 64)
    monkeypatch.setattr(pieces, "CACHE_PARTS", 50)
    _same(pieces.Encoder(model), library, [t for t, _ in list(documents.values())[:40]] + _texts(200, 2))


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc", "nfkc_cf", "nmt_nfkc_cf", "identity"])
@pytest.mark.parametrize("squeeze", [True, False])
@pytest.mark.parametrize("escape", [True, False])
def test_character_maps(rule, squeeze, escape):
    """The compiled map of each public rule, walked here, gives the library's text and places."""
    theirs = SentencePieceNormalizer(
        rule_name=rule, add_dummy_prefix=squeeze, remove_extra_whitespaces=squeeze, escape_whitespaces=escape
    )
    rules = {}
    for number, value in pieces.fields(theirs.serialized_model_proto()):
        if number == 3:
            rules = dict(pieces.fields(value))
    own = pieces.Normaliser(rules.get(2, b""), prefix=squeeze, squeeze=squeeze, escape=escape)
    for text in _texts(400, 3) + [" ", "  x  ", "x 　 y", " ", ""]:
        want, places = theirs.normalize(text, with_offsets=True)
        normal, source = own(text.encode())
        assert normal.decode() == want, repr(text)
        # The library counts characters on both sides; bytes of one character share their place.
        first = [len(want[:k].encode()) for k in range(len(want) + 1)]
        to_character = {len(text[:k].encode()): k for k in range(len(text) + 1)}
        assert [to_character[p] for p in source[first].tolist()] == list(places), repr(text)


def test_bytes_that_are_no_text(model):
    encoder = pieces.Encoder(model)
    raw = b"ab\xff c\xe2\x82 \xed\xa0\x80z"
    ((ids, start, end),) = list(encoder.encode([raw]))
    normal, source = encoder.normalise(raw)
    assert normal.decode() == "▁ab�▁c��▁���z"
    assert source[-1] == len(raw) and (end[1:-1] <= len(raw)).all()
    assert encoder.decode(ids.tolist()) == normal.decode()[1:].replace("▁", " ")


def test_symbols_of_the_model_stay_whole():
    own = pieces.Normaliser(symbols=(b"<x>", b"<x>y"))
    assert own(b"a  <x>y <x> b")[0].decode() == "▁a▁<x>y▁<x>▁b"


def _row(library, text) -> tuple:
    ids = library.encode(text or "", add_bos=True, add_eos=True)
    hexed = lambda b: hashlib.sha256(b).hexdigest()
    return len(ids), hexed(np.array(ids, "<u4").tobytes()), hexed(library.decode(ids).encode())


def test_query(spark, library, documents):
    rows = queries.op12_pieces(spark, SF).collect()
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows}
    assert got == {i: _row(library, t) for i, (t, _) in documents.items()}


def test_odd_tables_and_round_trip(spark, library, odd, none):
    rows = pieces.digests(odd, MODEL).collect()
    assert len(rows) == odd.count()
    by_id = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows if r.doc_id not in (3, None)}
    for i, text in enumerate(ODD_TEXTS):
        if i != 3:
            assert by_id[i] == _row(library, text)
    encoded = pieces.encode(odd, MODEL)
    back = {r.doc_id: r.text for r in pieces.decode(encoded, MODEL).collect()}
    for i, text in enumerate(ODD_TEXTS):
        if i != 3:
            assert back[i] == (text or "")
    assert pieces.encode(none, MODEL).count() == pieces.digests(none, MODEL).count() == 0
    assert pieces.decode(encoded.where("false"), MODEL).count() == 0


def test_query_reads_whole_documents(spark):
    assert queries.op12_pieces(spark, SF).count() == common.read(spark, SF, "documents").count()
