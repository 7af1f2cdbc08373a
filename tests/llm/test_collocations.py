"""Phrases from the graph of word grams, against counting every phrase by itself."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from pairgauge.llm import collocations

from . import plain

SCHEMA = "text string, lang string, n string, size string"


def plain_collocations(docs, least=30, top=2000):
    f = defaultdict(Counter)
    for text, lang in docs:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", plain.lowered(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            for size in range(1, 5):
                for i in range(len(words) - size + 1):
                    f[lang or "und"][tuple(words[i : i + size])] += 1
    rows = []
    for lang, counted in f.items():
        n = sum(c for p, c in counted.items() if len(p) == 1)
        candidates = {p: c for p, c in counted.items() if len(p) > 1 and c >= least}
        inside = Counter()
        for p, c in candidates.items():
            for size in range(2, len(p)):
                for i in range(len(p) - size + 1):
                    inside[p[i : i + size]] = max(inside[p[i : i + size]], c)
        scored = []
        for p, a in candidates.items():
            if 100 * inside[p] >= 80 * a:
                continue
            cuts = [(2_000_000 * a // (counted[p[:k]] + counted[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            scored.append((-score, -a, " ".join(p).encode(), counted[p[:k]], counted[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[:top]):
            rows.append((lang, rank + 1, phrase.decode(), -a, left, right, n, -score))
    return sorted(rows)


def _got(df):
    names = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    return sorted(tuple(r[c] for c in names) for r in df.collect())


def _random(seed, n=150):
    """Few words, passages that return, loops, pieces of every length and pairs that cross languages."""
    rng = random.Random(seed)
    passage = [" ".join(f"p{q}w{k}" for k in range(12)) for q in range(3)]
    rows = []
    for _ in range(n):
        out = []
        for _ in range(rng.randrange(12)):
            kind = rng.randrange(8)
            if kind == 0:
                out.append(rng.choice(passage))
            elif kind == 1:
                out.append(" ".join(["x y z"] * rng.randrange(1, 5)))
            elif kind == 2:
                out.append("a " * rng.randrange(1, 9))
            else:
                out.append(" ".join(rng.choice("The a b c Ünï d".split()) for _ in range(rng.randrange(7))))
            out.append(rng.choice([" ", ". ", ",", "\n", "\t", "!?", "\x0b"]))
        rows.append(("".join(out), rng.choice(["en", "de", None]), "n", "s"))
    return rows


@pytest.mark.parametrize("seed, least", [(1, 5), (2, 10), (3, 2), (4, 30)])
def test_matches_plain_counts(spark, monkeypatch, seed, least):
    monkeypatch.setattr(collocations, "PATH", 4)
    rows = _random(seed)
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert _got(collocations.collocations(df, least, cell_bits=20)) == plain_collocations([r[:2] for r in rows], least)


def test_full_counters_only_cost_work(spark):
    """With so few counters that each serves many pairs, results stay the same."""
    rng = random.Random(5)
    rows = [(" ".join(f"w{rng.randrange(300)}" for _ in range(400)), "en", "", "") for _ in range(60)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = collocations.collocations(df, 3, top=50, cell_bits=16, flush=50)
    assert _got(got) == plain_collocations([r[:2] for r in rows], 3, 50)


def test_paths_hold_every_heavy_edge_once(spark):
    passage = " ".join(f"q{k}" for k in range(40))
    rows = [(passage, "en", "", "")] * 30 + [("r s t " * 20, "en", "", "")] * 3 + [("o " * 40, "en", "", "")]
    grams = collocations.edges(spark.createDataFrame(rows, SCHEMA))
    found = [(r.words, r.n) for r in collocations.paths(grams).collect()]
    assert (passage.split(), 30) in found
    windows = [tuple(w[i : i + 4]) for w, _ in found for i in range(len(w) - 3)]
    heavy = grams.where("size = 4 AND n >= 30").select(F.split("gram", " ").alias("g")).collect()
    assert sorted(windows) == sorted(tuple(r.g) for r in heavy)


def test_a_ring_without_entry_stays_in_single_edges(spark):
    text = " ".join(["k l m n o"] * 40)
    grams = collocations.edges(spark.createDataFrame([(text, "en", "", "")] * 2, SCHEMA))
    ring = grams.where("size = 4").withColumn("n", F.lit(70).cast("bigint"))
    assert sorted(" ".join(r.words) for r in collocations.paths(ring).collect()) == [
        "k l m n", "l m n o", "m n o k", "n o k l", "o k l m",
    ]


def test_odd_tables(spark, odd, none):
    docs = [(r.text, r.lang) for r in odd.collect()]
    assert _got(collocations.collocations(odd, 2)) == plain_collocations(docs, 2)
    assert collocations.collocations(none).count() == 0
    assert collocations.collocations(odd.where("doc_id < 4"), 2).count() == 0
    bare = spark.createDataFrame([(None, None)] * 3 + [("x y", None)] * 30, "text string, lang string")
    assert _got(collocations.collocations(bare)) == [("und", 1, "x y", 30, 30, 30, 60, 1_000_000)]
