"""Near duplicates, vectors, repeated passages and fingerprints."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest

from pairgauge.llm import chunks, common, components, forest, minhash, orderhash, words

from . import plain
from .conftest import LONG, SF


def test_components_of_paths_stars_and_loops(spark):
    pairs = [(k, k + 1) for k in range(100, 140)] + [(7, k) for k in range(8, 30)] + [(5, 5), (3, 2), (2, 3)]
    found = components.components(spark.createDataFrame(pairs, "a bigint, b bigint"))
    got = {r.node: r.root for r in found.collect()}
    nodes = {x for p in pairs for x in p}
    want = plain.components(nodes, pairs)
    assert got == {i: r for i, r in want.items() if i != 5}


@pytest.mark.parametrize("size", [2, 5])
def test_classes_equal_all_pairs(spark, documents, size):
    sets = {i: plain.shingle_set(t, size) for i, (t, _) in documents.items()}
    want = plain.components(sets, plain.near_links(sets))
    docs = common.read(spark, SF, "documents")
    got = {r.doc_id: r for r in minhash.near_duplicates(docs, shingle=size).collect()}
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == {
        i: (len(sets[i]), want[i], want[i] == i) for i in sets
    }


def _edited(seed: int, base: list[str], edits: int) -> str:
    rng = np.random.default_rng(seed)
    own = list(base)
    for at in rng.choice(len(own), edits, replace=False):
        own[at] = f"new{seed}x{at}"
    return " ".join(own)


def test_large_group_in_blocks_keeps_links_through_one_original(spark):
    base = [f"w{k}" for k in range(120)]
    texts = [_edited(k, base, 9) for k in range(60)] + [" ".join(base)]
    texts += [_edited(900 + k, [f"v{j}" for j in range(120)], 3) for k in range(10)]
    rows = [(k, t) for k, t in enumerate(texts)]
    sets = {k: plain.shingle_set(t, 2) for k, t in rows}
    want = plain.components(sets, plain.near_links(sets))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = minhash.near_duplicates(df, shingle=2, block=16).collect()
    assert {r.doc_id: r.component_id for r in got} == want


def test_classes_of_odd_rows(spark, odd, none):
    got = minhash.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert [r.n_shingles for r in by[0] + by[1] + by[2]] == [0, 0, 0]
    assert all(r.kept for r in by[0] + by[1] + by[2])
    assert {r.component_id for r in by[6] + by[7]} == {6}
    assert {r.component_id for r in by[8] + by[9]} == {8}
    assert by[None][0].kept
    assert minhash.deduplicated(none).count() == 0
    kept = minhash.deduplicated(odd)
    assert kept.columns == odd.columns
    ids = sorted((r.doc_id for r in kept.collect()), key=str)
    assert ids.count(6) == 1 and 7 not in ids and 9 not in ids and None in ids


def test_signatures_estimate_likeness():
    rng = np.random.default_rng(1)
    values = np.unique(rng.integers(0, 1 << 63, 3000, dtype=np.uint64))
    a, b = values[:2000], values[400:2400]
    both = minhash.signatures(np.concatenate([a, b]), np.array([len(a), len(b)]))
    assert abs((both[0] == both[1]).mean() - 1600 / 2400) < 0.15
    few = minhash.signatures(a[:1], np.array([1]))
    assert len(np.unique(few)) == 1


def _brute_vectors(rows):
    x = np.array([v for _, v in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    a, b = np.nonzero(np.triu(x @ x.T >= 0.95, 1))
    ids = [i for i, _ in rows]
    links = [(ids[p], ids[q]) for p, q in zip(a.tolist(), b.tolist(), strict=True)]
    count = dict.fromkeys(ids, 0)
    for p, q in links:
        count[p] += 1
        count[q] += 1
    return count, plain.components(ids, links)


@pytest.mark.parametrize(
    "options", [{}, {"sample": 60, "leaf_rows": 40, "block": 16, "trees": 8}], ids=["plain", "refined"]
)
def test_linked_vectors(spark, options):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((30, 24))
    rows = [(k, rng.standard_normal(24).tolist()) for k in range(200)]
    rows += [(200 + k, (centres[k % 30] + 0.1 * rng.standard_normal(24)).tolist()) for k in range(180)]
    rows += [(400 + k, (centres[0] + 0.001 * rng.standard_normal(24)).tolist()) for k in range(80)]
    rows += [(500 + k, rows[0][1]) for k in range(5)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = {r.vec_id: r for r in forest.cosine_classes(df, **options).collect()}
    count, component = _brute_vectors(rows)
    found, there = sum(r.n_links for r in got.values()), sum(count.values())
    assert all(got[i].n_links <= count[i] for i in count)
    assert found >= 0.97 * there
    if not options:
        assert {i: r.component_id for i, r in got.items()} == component
        assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_vectors_that_link_with_nothing(spark):
    rows = [
        (1, None), (2, [0.0, 0.0]), (3, [1.0, None]), (4, [1.0, float("nan")]), (5, [float("inf"), 1.0]),
        (6, [1.0, 0.0]), (7, [2.0, 0.0]), (7, [2.0, 0.0]), (None, [1.0]), (8, [0.0, 0.0]), (9, []),
    ]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = forest.cosine_classes(df).collect()
    assert len(got) == len(rows)
    lone = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got if r.vec_id in (1, 2, 3, 4, 5, 8, 9)}
    assert lone == {i: (0, i, True) for i in (1, 2, 3, 4, 5, 8, 9)}
    assert {(r.n_links, r.component_id) for r in got if r.vec_id in (6, 7, None)} == {(3, 6)}
    assert forest.cosine_classes(df.limit(0)).count() == 0


def _plain_cuts(text: bytes) -> list[int]:
    ends, last, h = [], 0, 0
    for k, byte in enumerate(text):
        h = ((h << 1) + int(chunks.GEAR[byte])) & 0xFFFFFFFF
        whole = k + 1 == len(text) or text[k + 1] & 0xC0 != 0x80
        if h >> (32 - chunks.CUT_BITS) == 0 and whole and k + 1 - last >= chunks.MIN_BYTES:
            ends.append(k + 1)
            last = k + 1
    return ends if last == len(text) else [*ends, len(text)]


def test_cuts_follow_the_rolling_hash(documents):
    texts = [t.encode() for t, _ in documents.values()][:40] + [b"", b"a" * 500]
    offsets = np.append(0, np.cumsum([len(t) for t in texts]))
    got = chunks.cuts(np.frombuffer(b"".join(texts), np.uint8), offsets)
    assert got == [_plain_cuts(t) for t in texts]


def test_planted_passage_is_found_and_clean_texts_are_not(spark, odd, none):
    rng = np.random.default_rng(3)
    vocabulary = ["".join(chr(97 + c) for c in rng.integers(0, 26, n)) for n in rng.integers(2, 9, 4000)]
    draw = lambda n: " ".join(vocabulary[k] for k in rng.integers(0, 4000, n))
    passage = draw(55)
    rows = [(k, f"{draw(80)} {passage} {draw(40 + k)}" if k < 6 else draw(150)) for k in range(30)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    spans = chunks.repeats(df).collect()
    assert {r.doc_id for r in spans} == set(range(6))
    for r in spans:
        text = rows[r.doc_id][1]
        assert text[r.start : r.start + r.length] in text[text.index(passage) - 60 :]
        # The chunk at an end of the passage may be shared by later documents only.
        assert r.removable == 0 if r.doc_id == 0 else r.removable >= 0.6 * r.length
    held = {(r.doc_id, r.n_words) for r in chunks.repeats(odd).collect()}
    assert {i for i, _ in held} == {8, 9}
    assert chunks.repeats(none).count() == 0


def test_chunks_cover_every_text(spark, odd):
    rows = chunks.chunked(odd).orderBy("row", "number").collect()
    lengths = {}
    for r in rows:
        assert r.start == lengths.get(r.row, 0)
        lengths[r.row] = r.start + r.length
    want = sorted(len(t or "") for t in [r.text for r in odd.collect()] if t)
    assert sorted(lengths.values()) == want


def _next(rows):
    order = sorted(rows, reverse=True)
    return {i: j for i, j in zip(order, order[1:] + order[:1], strict=True)}


def test_fingerprints(spark, documents):
    got = {r.doc_id: r for r in orderhash.fingerprints(common.read(spark, SF, "documents")).collect()}
    after, seen = _next(documents), {}
    for i, r in got.items():
        text, other = documents[i][0], documents[after[i]][0]
        half = len(text) // 2
        edited = text[: len(text) - half] + other[:half]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert seen.setdefault(text, r.fingerprint) == r.fingerprint
        assert (r.fingerprint == r.edited_fingerprint) == (r.near_edited == 1.0)
    assert 0.4 < np.mean([r.near_edited for r in got.values()]) < 0.6
    assert np.mean([r.near_next for r in got.values()]) < 0.1


def test_fingerprints_see_order(spark):
    own = [f"t{k}" for k in range(400)]
    moved = own[200:] + own[:200]
    mild = [w if k % 40 else "x" for k, w in enumerate(own)]
    rows = [(3, " ".join(own)), (2, " ".join(moved)), (1, " ".join(mild)), (0, " ".join(reversed(own)))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    p = {r.doc_id: r.fingerprint for r in orderhash.fingerprints(df).collect()}
    pairs = spark.createDataFrame([(p[3], p[2]), (p[3], p[1]), (p[3], p[0])], "a string, b string")
    like = [r[0] for r in pairs.select(orderhash.likeness(pairs["a"], pairs["b"])).collect()]
    assert like[0] < 0.9 and like[1] > 0.8 and like[2] < 0.1


def test_fingerprints_of_odd_rows(spark, odd, none):
    got = orderhash.fingerprints(odd).collect()
    assert len(got) == odd.count()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert by[0][0].n_chars == 0 and by[0][0].fingerprint == by[1][0].fingerprint == by[2][0].fingerprint
    assert by[6][0].fingerprint == by[7][0].fingerprint
    assert by[8][0].n_chars == len(LONG)
    # The row without an id comes last and is followed by the first.
    assert len(by[None]) == 1 and by[None][0].n_chars == len("no id here at all")
    assert orderhash.fingerprints(none).count() == 0


def test_occurrences_count(spark):
    df = spark.createDataFrame([(0, "a b c a b c a b c"), (1, "a b c")], "doc_id bigint, body string")
    items = {r.doc_id: r["items"] for r in orderhash.items(df, "body").collect()}
    assert len(items[0]) == 7 and len({x >> orderhash.PLACE_BITS for x in items[0]}) == 7
    assert sorted(x & (1 << orderhash.PLACE_BITS) - 1 for x in items[0]) == list(range(7))
    first = {x >> orderhash.PLACE_BITS for x in items[1]}
    assert first < {x >> orderhash.PLACE_BITS for x in items[0]}


def test_word_hashes_do_not_depend_on_place():
    data = np.frombuffer(b"alpha beta alpha\nbeta", np.uint8)
    owner, start, end = words.find(data, np.array([0, 11, len(data)]), words.NOT_BLANK)
    h = words.hashes(data, start, end)
    assert owner.tolist() == [0, 0, 1, 1] and h[0] == h[2] and h[1] == h[3] and h[0] != h[1]
    again = words.hashes(data, start, end, again=True)
    assert not set(h.tolist()) & set(again.tolist())
