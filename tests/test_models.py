"""Model tables for unseen rows and trees of all folds at once, against plain versions."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairgauge import constants as C
from pairgauge.functions.linear import solved
from pairgauge.functions.ranks import numbered
from pairgauge.operators import models, recommend, trees

from .test_recommend import ROWS, _meta

FEATURES = ["n_samples", "missing_fraction", "n_classes"]


def test_linear_systems_are_solved_row_by_row(spark):
    rng = np.random.default_rng(3)
    systems = []
    for k in range(20):
        a = rng.normal(size=(6, 4))
        left, right = a.T @ a + np.eye(4), rng.normal(size=4)
        systems.append((k, np.column_stack([left, right]).tolist(), np.linalg.solve(left, right)))
    df = spark.createDataFrame([s[:2] for s in systems], "k int, m array<array<double>>")
    found = {r.k: r.x for r in df.select("k", solved(F.col("m"), 4).alias("x")).collect()}
    for k, _, x in systems:
        assert np.allclose(found[k], x, atol=1e-10)


def test_rows_are_numbered_over_partitions(spark):
    df = spark.range(3000).selectExpr("id", "id % 13 AS part").repartition(9)
    got = numbered(df, [F.desc("part"), F.col("id")]).collect()
    want = sorted(range(3000), key=lambda i: (-(i % 13), i))
    assert [r.id for r in sorted(got, key=lambda r: r.number)] == want
    assert numbered(df.where("false"), [F.col("id")]).count() == 0


def test_ridge_of_unseen_rows_matches_the_normal_equations(spark):
    meta = _meta(spark)
    new = spark.createDataFrame([("new", 400.0, 0.5, 2.0), ("far", 9.0, 0.0, 3.0)], "dataset string, n_samples double, missing_fraction double, n_classes double")
    fitted = models.train(meta, "ridge")
    told = {r.dataset: r.predicted_gap for r in models.predict(fitted, new, FEATURES).collect()}
    x = np.array([r[2:5] for r in ROWS])
    y = np.array([r[6] - r[5] for r in ROWS])
    scale = x.std(0)
    scale[scale == 0] = 1
    z = (x - x.mean(0)) / scale
    w = np.linalg.solve(z.T @ z + np.eye(3), z.T @ (y - y.mean()))
    for r in new.collect():
        want = y.mean() + (np.array(r[1:]) - x.mean(0)) / scale @ w
        assert abs(told[r.dataset] - want) < 1e-10
    # The same columns and rows give the in-sample fit.
    same = {r.dataset: r.predicted_gap for r in recommend.in_sample(meta, "ridge").collect()}
    own = models.predict(fitted, meta.drop(C.GAP), FEATURES)
    assert all(abs(r.predicted_gap - same[r.dataset]) < 1e-10 for r in own.collect())


def test_models_survive_being_written(spark, tmp_path):
    meta = _meta(spark)
    for kind in models.KINDS:
        fitted = models.train(meta, kind)
        fitted.write.parquet(str(tmp_path / kind))
        back = spark.read.parquet(str(tmp_path / kind))
        rows = [sorted(tuple(r) for r in models.predict(m, meta, FEATURES).collect()) for m in (fitted, back)]
        assert rows[0] == rows[1] and {r[-1] for r in rows[0]} <= {"GBDT", "DNN"}


def test_groups_and_their_status(spark):
    rows = [(f"d{k}", g, float(k), 0.5, 2.0, y) for k, (g, y) in enumerate(
        [("a", 0.25), ("a", 0.5), ("a", 0.0), ("b", 0.1), ("c", 0.3), ("c", None)])]
    meta = spark.createDataFrame(rows, f"dataset string, place string, n_samples double, missing_fraction double, n_classes double, {C.GAP} double")
    for kind in models.KINDS:
        fitted = models.train(meta, kind, by="place")
        assert {r.model: r.status for r in fitted.collect()} == {"a": "ok", "b": "too_few_rows", "c": "missing_values"}
        told = {r.place: r for r in models.predict(fitted, meta.withColumn("place", F.lit("a")).limit(1), FEATURES, "place").collect()}
        assert told["a"].predicted_gap is not None
        others = spark.createDataFrame([("x", "b", 1.0, 0.0, 2.0), ("y", "zz", 1.0, 0.0, 2.0)], "dataset string, place string, n_samples double, missing_fraction double, n_classes double")
        assert all(r.predicted_gap is None and r.recommendation is None for r in models.predict(fitted, others, FEATURES, "place").collect())


def test_refusals(spark):
    meta = _meta(spark)
    with pytest.raises(ValueError, match="two datasets"):
        models.train(meta.limit(1))
    with pytest.raises(ValueError, match="two datasets"):
        models.train(meta.where("false"), "random_forest")
    with pytest.raises(ValueError, match="missing values"):
        models.train(meta.withColumn("n_samples", F.when(F.col("dataset") != "oak", F.col("n_samples"))))
    with pytest.raises(ValueError, match="Unknown"):
        models.train(meta, "oracle")
    with pytest.raises(ValueError, match="taken"):
        models.predict(models.train(meta, "dummy_mean"), meta.withColumn("model", F.lit(1)), FEATURES)
    with pytest.raises(Exception, match="other columns"):
        models.predict(models.train(meta, "ridge"), meta, FEATURES[::-1]).collect()
    with pytest.raises(Exception, match="non-finite"):
        models.predict(models.train(meta, "ridge"), meta.withColumn("n_samples", F.lit(float("nan"))), FEATURES).collect()


def test_extra_descriptors_predict_and_clinical_rows_stay_out(spark):
    meta = _meta(spark).withColumn("skew", F.length("dataset").cast("double")).withColumn("clinical", F.col("family") == "fish")
    fitted = models.train(meta, "ridge", extra=True).first()
    assert fitted["features"] == [*FEATURES, "skew"] and fitted["n_rows"] == 5
    told = models.predict(models.train(meta, "ridge", extra=True), meta, [*FEATURES, "skew"])
    assert told.count() == len(ROWS)


# --- trees -------------------------------------------------------------------------------


def _weight(seed, tree, name):
    share = (int(hashlib.md5(f"{seed}|{tree}|{name}".encode()).hexdigest()[:8], 16) + 0.5) / 2**32
    upto, n = 0.0, 0
    for k in range(12):
        upto += math.exp(-1) / math.factorial(k)
        n += share > upto
    return n


def _plain_tree(rows, depth):
    """Rows are (x, y, w); a function of x."""
    rows = [r for r in rows if r[2] > 0]
    total = sum(r[2] for r in rows)
    value = sum(r[1] * r[2] for r in rows) / total if total else None
    best = (float("-inf"), None, None)
    if depth and len(rows) >= 4:
        for f in range(len(rows[0][0])):
            levels = sorted({r[0][f] for r in rows})
            for low, high in zip(levels, levels[1:], strict=False):
                left = [r for r in rows if r[0][f] <= low]
                right = [r for r in rows if r[0][f] > low]
                if len(left) < 2 or len(right) < 2:
                    continue
                gain = sum(sum(r[1] * r[2] for r in side) ** 2 / sum(r[2] for r in side) for side in (left, right))
                middle = (low + high) / 2
                if gain > best[0]:
                    best = (gain, f, middle if middle < high else low)
    if best[1] is None:
        return lambda x: value
    _, f, at = best
    low = _plain_tree([r for r in rows if r[0][f] <= at], depth - 1)
    high = _plain_tree([r for r in rows if r[0][f] > at], depth - 1)
    return lambda x: low(x) if x[f] <= at else high(x)


def _cases(seed, n=40):
    rng = random.Random(seed)
    # Targets and features are sums of powers of two, so no engine rounds.
    return [
        (f"d{k}", f"f{rng.randrange(6) if k % 3 else 0}", rng.randrange(-40, 40) / 64,
         [float(rng.randrange(9)), rng.randrange(4) / 4, float(rng.randrange(30)), 1.0])
        for k in range(n)
    ]


@pytest.mark.parametrize("shape", [trees.Shape(1, 3, False), trees.Shape(7, 5, True, 11)])
@pytest.mark.parametrize("seed", [1, 2])
def test_held_out_trees_match_a_plain_version(spark, shape, seed):
    cases = _cases(seed)
    df = spark.createDataFrame([("all", d, f, y, *x) for d, f, y, x in cases], "group string, dataset string, fold string, y double, a double, b double, c double, d double")
    names = ["a", "b", "c", "d"]
    found = []
    for layout in (df.coalesce(1), df.repartition(7)):
        _, told = trees.grow(layout, names, shape, layout.select("group", "fold").distinct())
        found.append({r.dataset: r.predicted for r in told.collect()})
    assert found[0] == found[1]
    for fold in {c[1] for c in cases}:
        grown = [
            _plain_tree([(x, y, _weight(shape.seed, t, d) if shape.bootstrap else 1) for d, f, y, x in cases if f != fold], shape.depth)
            for t in range(shape.trees)
        ]
        for d, f, _, x in cases:
            if f == fold:
                want = [v for v in (tree(x) for tree in grown) if v is not None]
                assert abs(found[0][d] - sum(want) / len(want)) < 1e-12


def test_best_split_is_found_in_one_pass_over_the_cells():
    rng = np.random.default_rng(4)
    m = rng.integers(1, 4, 1024)
    total = (np.arange(1024), m, m + rng.integers(0, 2, 1024), rng.normal(size=1024))
    own = tuple(x[::2] for x in total)
    rest = tuple(x[1::2] for x in total)
    assert trees._best_split(total, own) == trees._best_split(rest, tuple(x[:0] for x in total))
    bins, m, w, s = rest
    gains = {
        k: s[:k].sum() ** 2 / w[:k].sum() + s[k:].sum() ** 2 / w[k:].sum()
        for k in range(1, len(bins)) if m[:k].sum() >= 2 and m[k:].sum() >= 2
    }
    best = max(gains, key=gains.get)
    gain, left, right = trees._best_split(total, own)
    assert (left, right) == (bins[best - 1], bins[best]) and abs(gain - gains[best]) < 1e-9
    assert trees._best_split(tuple(x[:1] for x in total), tuple(x[:0] for x in total)) is None


def test_stored_trees_tell_new_rows(spark):
    cases = _cases(5, 60)
    df = spark.createDataFrame([(d, f, y, *x) for d, f, y, x in cases], f"dataset string, place string, {C.GAP} double, a double, b double, c double, d double")
    names = ["a", "b", "c", "d"]
    fitted = models.train(df, "decision_tree", names, by="place")
    rng = random.Random(6)
    new = [(f"n{k}", f"f{k % 6}", *(rng.uniform(-1, 31) for _ in names)) for k in range(50)]
    told = models.predict(fitted, spark.createDataFrame(new, "dataset string, place string, a double, b double, c double, d double"), names, "place")
    got = {r.dataset: r.predicted_gap for r in told.collect()}
    for place in {c[1] for c in cases}:
        tree = _plain_tree([(x, y, 1) for _, f, y, x in cases if f == place], 3)
        for name, own, *x in new:
            if own == place:
                assert abs(got[name] - tree(x)) < 1e-12


def test_bins_hold_equal_numbers_of_values(spark, monkeypatch):
    monkeypatch.setattr(trees, "BINS", 4)
    df = spark.range(40).selectExpr("'g' AS group", "concat('d', id) AS dataset", "'f' AS fold", "double(id) AS y", "double(id * id) AS x")
    rows, edges = trees._binned(df, ["x"])
    assert rows.select(F.col("cells")[0]["bin"].alias("b")).groupBy("b").count().orderBy("b").collect() == [(k, 10) for k in range(4)]
    assert [(r.low, r.high) for r in edges.orderBy("bin").collect()][0] == (0.0, 81.0)
    tiny = df.where("id < 0")
    assert trees.grow(tiny, ["x"], trees.SHAPES["decision_tree"], tiny.select("group", "fold"))[1].count() == 0


@pytest.mark.parametrize("shape", [trees.Shape(1, 3, False), trees.Shape(12, 4, True, 5)])
def test_a_task_grows_the_trees_that_counts_over_all_tasks_grow(spark, monkeypatch, shape):
    """Thirds and sevenths round, names repeat in two folds, values are NaN, infinite or more than there are bins."""
    monkeypatch.setattr(trees, "BINS", 16)
    rng = random.Random(8)
    rows = [
        (g, f"d{k}", f"f{rng.randrange(4)}", rng.randrange(-9, 9) / 7, rng.gauss(0, 1), rng.randrange(3) / 3, rng.choice([0.0, -0.0, 1.0, math.inf, math.nan]))
        for g in ("u", "v") for k in range(50)
    ]
    rows += [("u", f"d{k}", f"f{rng.randrange(4)}", 0.5, rng.gauss(0, 1), 0.0, 1.0) for k in range(0, 50, 9)]
    rows += [("w", "only", "f0", 0.5, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "group string, dataset string, fold string, y double, a double, b double, c double")
    folds = df.select("group", "fold").distinct().unionByName(spark.createDataFrame([("u", "none of them"), ("x", "f0")], "group string, fold string"))
    found = []
    for held in (trees.HELD, 60, 0):
        monkeypatch.setattr(trees, "HELD", held)
        nodes, told = trees.grow(df, ["a", "b", "c"], shape, folds)
        found.append((sorted(nodes.collect(), key=str), {(r.group, r.dataset): r.predicted for r in told.collect()}))
    assert len(found[0][0]) > 100 * (shape.trees > 1)
    for nodes, told in found[1:]:
        assert nodes == found[0][0] and told.keys() == found[0][1].keys()
        for k, v in told.items():
            assert v == found[0][1][k] or abs(v - found[0][1][k]) < 1e-12


def test_rows_of_a_group_are_not_taken_apart_by_tree_and_cell(spark, monkeypatch):
    """A forest that leaves out each of many folds is a few tasks, not counts per fold, tree, path and cell."""
    monkeypatch.setattr(trees, "_grow_spread", None)
    rng = random.Random(9)
    rows = [("all", f"d{k}", f"f{k % 25}", rng.gauss(0, 0.1), *(rng.gauss(0, 1) for _ in range(3))) for k in range(200)]
    df = spark.createDataFrame(rows, "group string, dataset string, fold string, y double, a double, b double, c double")
    nodes, told = trees.grow(df, ["a", "b", "c"], trees.Shape(30, 5, True), df.select("group", "fold").distinct())
    assert told.count() == 200 and nodes.select("fold", "tree").distinct().count() == 25 * 30
    with pytest.raises(TypeError):
        trees.grow(df.withColumn("y", F.lit(1e6)), ["a"], trees.SHAPES["decision_tree"], df.select("group", "fold").distinct())
