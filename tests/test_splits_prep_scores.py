from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from pairgauge.frame import LabelledFrame
from pairgauge.functions.exact import exact_medians
from pairgauge.operators import prep, scoring, splits, trials
from pairgauge.plans import rules
from pairgauge.protocol import FULL, SMOKE, candidates, grid


def _many(spark, parts: int):
    draw = random.Random(7)
    rows = []
    for dataset, n in (("big", 3000), ("small", 37), ("even", 60)):
        for i in range(n):
            rows.append((dataset, str(i), draw.choice([None, draw.random()]), int(draw.random() < 0.3)))
    df = spark.createDataFrame(rows, "dataset string, row_id string, x double, y int")
    return LabelledFrame(df.repartition(parts), ("x",), ())


def test_splits_do_not_depend_on_layout_or_buckets(spark):
    one = splits.assign_splits(_many(spark, 1), FULL.outer_seeds, 0.25, 3)
    other = splits.assign_splits(_many(spark, 13), FULL.outer_seeds, 0.25, 3, rows_per_bucket=7)
    rows = {tuple(r) for r in one.collect()}
    assert rows == {tuple(r) for r in other.collect()}
    assert len(rows) == 3 * 3097


def test_classes_as_lists_and_as_buckets_have_the_same_ends(spark):
    lf = _many(spark, 5)
    # A missing id is a row like any other; copies of a row count each.
    extra = spark.createDataFrame([("small", None, 0.5, 1), ("even", "3", 0.1, 0), ("even", "3", 0.1, 0)], lf.df.schema)
    lf = lf.with_df(lf.df.union(extra))
    lists = splits.block_cutoffs(lf, FULL.outer_seeds, 0.25, 3)
    buckets = splits.block_cutoffs(lf, FULL.outer_seeds, 0.25, 3, rows_per_bucket=1)
    # Listed classes have no bucket that could hold an end.
    assert lists.where("size(ends_42) = 3").count() == 6
    assert {tuple(map(str, r)) for r in lists.collect()} == {tuple(map(str, r)) for r in buckets.collect()}
    # Their row ids are exchanged once, whatever the number of seeds.
    plan = lists._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan


def test_rule_scores_exchange_counted_cells_only(spark):
    lf = _many(spark, 5)
    blocks = spark.createDataFrame(
        [(d, y, b, k, *[(b + k + s) % 4 for s in range(3)]) for d in "ab" for y in (0, 1) for b in range(-1, 16) for k in range(32)],
        "dataset string, y int, band int, bucket int, " + ", ".join(f"block_{s} int" for s in FULL.outer_seeds),
    )
    scores = rules.rule_scores(blocks, lf.keys, FULL.outer_seeds, FULL.inner_folds)
    plan = scores._jdf.queryExecution().executedPlan().toString()
    # One exchange of partial counts and one that brings the cells of a rule together.
    assert plan.split("== Initial Plan ==")[-1].count("Exchange hashpartitioning") <= 2
    found = rules.cell_counts(blocks, lf.keys, FULL.outer_seeds, FULL.inner_folds).where("dataset = 'a'").collect()
    assert {(r.family, r.cells, r.cell) for r in found} == (
        {("GBDT", n, c) for n in (4, 8, 16) for c in range(-1, n)} | {("DNN", n, c) for n in (8, 16, 32) for c in range(n)}
    )
    for family, cells, per in (("GBDT", 4, 4 * 64), ("DNN", 8, 4 * 34)):
        for r in found:
            if r.family == family and r.cells == cells and r.cell >= 0:
                assert sum(r[f"n_42_{p}"] for p in range(4)) == per and sum(r[f"p_42_{p}"] for p in range(4)) == per / 2


def test_rule_scores_order_cells_once(spark):
    """Cells are ordered by rising score only; ties and the cells above come from the same order."""
    lf = _many(spark, 2)
    blocks = splits.assign_blocks(
        lf.with_df(lf.df.withColumns({"band": F.lit(1), "bucket": F.lit(2)})),
        splits.block_cutoffs(lf, FULL.outer_seeds, 0.25, 3), FULL.outer_seeds, 3, carry=["band", "bucket"],
    )
    scores = rules.rule_scores(blocks, lf.keys, FULL.outer_seeds, 3)
    assert " DESC " not in scores._jdf.queryExecution().optimizedPlan().toString()
    assert {r["roc_auc"] for r in scores.collect()} == {0.5}


def test_listed_tokens_need_no_comparator(spark):
    ends = splits.block_cutoffs(_many(spark, 2), FULL.outer_seeds, 0.25, 3)
    assert "array_sort" not in ends._jdf.queryExecution().optimizedPlan().toString()


def test_split_sizes(spark):
    assigned = splits.assign_splits(_many(spark, 3), FULL.outer_seeds, 0.25, 3).cache()
    for row in assigned.groupBy("dataset", "outer_seed").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("part") == "test").alias("t")
    ).collect():
        assert row["t"] == -(-row["n"] // 4)
    sizes = splits.fold_sizes(assigned, ["dataset"], 3)
    assert sizes.filter("fold_rows <> expected_rows").count() == 0
    per_class = assigned.filter("part = 'train'").groupBy("dataset", "outer_seed", "y").agg(
        *[F.count_if(F.col("fold") == f).alias(f"f{f}") for f in range(3)]
    )
    for r in per_class.collect():
        assert max(r["f0"], r["f1"], r["f2"]) - min(r["f0"], r["f1"], r["f2"]) <= 1


def _encode(spark, schema, train, score=None, scaled=False):
    df = spark.createDataFrame([("d", str(i), 0, *r) for i, r in enumerate(train)],
                               f"dataset string, row_id string, y int, {schema}")
    numeric = tuple(f.name for f in df.schema.fields[3:] if f.dataType.simpleString() == "double")
    categorical = tuple(f.name for f in df.schema.fields[3:] if f.name not in numeric)
    lf = LabelledFrame(df, numeric, categorical)
    rows = lf if score is None else lf.with_df(
        spark.createDataFrame([("d", str(i), 0, *r) for i, r in enumerate(score)], df.schema)
    )
    out = prep.encode(rows, lf, prep.fit(lf), scaled).orderBy("row_id").collect()
    return out[0]["names"], [r["values"] for r in out]


def test_encoding_numeric_and_categories(spark):
    names, values = _encode(
        spark, "height double, fixed double, shore string, flag string",
        [(8.0, -2.0, "west", "y"), (2.0, -2.0, "east", "y"), (None, -2.0, None, "y"), (4.0, -2.0, "west", "y")],
    )
    assert names == [
        "height", "fixed", "missingindicator_height", "shore___missing__", "shore_east", "shore_west", "flag_y",
    ]
    assert values == [
        [8, -2, 0, 0, 0, 1, 1], [2, -2, 0, 0, 1, 0, 1], [4, -2, 1, 1, 0, 0, 1], [4, -2, 0, 0, 0, 1, 1],
    ]


def test_encoding_of_hollow_columns_and_new_levels(spark):
    names, values = _encode(
        spark, "depth double, kind string", [(None, None)] * 5, [(None, "reef"), (-3.5, None)]
    )
    assert names == ["depth", "missingindicator_depth", "kind___missing__"]
    assert values == [[0, 1, 0], [-3.5, 0, 1]]
    _, values = _encode(
        spark, "depth double, kind string", [(10.0, "reef"), (30.0, "sand"), (50.0, "reef")],
        [(None, "mud"), (-1.0, "sand")],
    )
    assert values == [[30, 0, 0], [-1, 0, 1]]


def test_scaling_leaves_levels_alone(spark):
    train = [(1.0, 3.0, "q"), (2.0, 3.0, None), (None, 3.0, "p"), (9.0, 3.0, "q"), (4.0, 3.0, "q")]
    _, values = _encode(spark, "a double, same double, c string", train, scaled=True)
    filled = np.array([1, 2, 3, 9, 4.0])
    gap = np.array([0, 0, 1, 0, 0.0])
    unit = lambda v: (v - v.mean()) / v.std()
    levels = np.array([[0, 0, 1], [1, 0, 0], [0, 1, 0], [0, 0, 1], [0, 0, 1]])
    assert np.allclose(values, np.column_stack([unit(filled), np.zeros(5), unit(gap), levels]))


def test_wide_datasets_keep_their_levels(spark):
    """A dataset above the size limit is reported, not left out."""
    rows = [(d, f"{k}", 0, f"v{k % n}") for d, n in (("wide", 90), ("slim", 2)) for k in range(90)]
    lf = LabelledFrame(
        spark.createDataFrame(rows, "dataset string, row_id string, y int, c string"), (), ("c",)
    )
    status = {r["dataset"]: r["status"] for r in prep.matrix_guard(prep.encoded_widths(lf), 9000).collect()}
    assert status == {"wide": "too_large", "slim": "ok"}
    counted = prep.level_index(lf).groupBy("dataset").count().collect()
    assert {r["dataset"]: r["count"] for r in counted} == {"wide": 90, "slim": 2}
    assert prep.encode(lf, lf, prep.fit(lf)).groupBy("dataset").count().count() == 2


def test_matrix_guard_at_the_limit(spark):
    df = spark.createDataFrame([("d", 3, 5)], "dataset string, n_rows long, n_encoded_features long")
    assert prep.matrix_guard(df, 120).first()["status"] == "ok"
    assert prep.matrix_guard(df, 112).first()["status"] == "too_large"


def test_exact_median_with_a_coarse_sketch(spark):
    draw = random.Random(3)
    groups = {g: [round(draw.gauss(0, 5), 2) for _ in range(n)] for g, n in
              (("a", 4001), ("b", 4000), ("c", 2), ("d", 1))}
    groups["hot"] = [1.0] * 3000 + [2.0] * 3000
    rows = [(g, v) for g, values in groups.items() for v in values]
    df = spark.createDataFrame(rows, "dataset string, x double").repartition(5)
    found = {r["dataset"]: r["median"]
             for r in exact_medians(df, ["dataset"], ["x"], accuracy=100).collect()}
    assert found == {g: float(np.median(v)) for g, v in groups.items()}


def test_prediction_scores(spark):
    y = [1, 0, 0, 1, 0, 0, 1, 0]
    guess = [1, 0, 1, 0, 0, 0, 1, 0]
    score = [0.7, 0.35, 0.6, 0.35, 0.1, 0.05, 0.9, 0.2]
    df = spark.createDataFrame(list(zip(y, guess, score, strict=True)), "y int, prediction int, score double")
    df = df.withColumn("k", F.lit("k"))
    row = scoring.prediction_scores(df, ["k"]).first()
    assert abs(row["balanced_accuracy"] - (2 / 3 + 4 / 5) / 2) < 1e-12
    assert abs(row["roc_auc"] - 13.5 / 15) < 1e-12 and row["status"] == "success"
    broken = df.withColumn("score", F.when(F.col("score") < 0.08, float("inf")).otherwise(0.25))
    assert scoring.prediction_scores(broken, ["k"]).first()["status"] == "failure"


def test_auc_is_the_same_in_buckets(spark):
    draw = random.Random(5)
    rows = [(draw.choice("ab"), int(draw.random() < 0.4), round(draw.random(), 3))
            for _ in range(4000)]
    df = spark.createDataFrame(rows, "k string, y int, score double")
    whole = {r["k"]: r["roc_auc"] for r in scoring.roc_auc(df, ["k"]).collect()}
    cut = {r["k"]: r["roc_auc"] for r in scoring.roc_auc(df, ["k"], scores_per_task=10).collect()}
    assert whole == cut
    for k in "ab":
        pos = np.array([s for g, y, s in rows if g == k and y == 1])
        neg = np.array([s for g, y, s in rows if g == k and y == 0])
        pairs = (pos[:, None] > neg[None]).mean() + (pos[:, None] == neg[None]).mean() / 2
        assert abs(whole[k] - pairs) < 1e-12


def test_tie_goes_to_the_lowest_order(spark):
    scores = {11: (0.5, 0.6, 0.7), 4: (0.7, 0.5, 0.6), 9: (0.3, 0.9, 0.4), 6: (0.6, 0.6, 0.6)}
    rows = [("d", "DNN", o, f, s, s / 2, "success") for o, own in scores.items() for f, s in enumerate(own)]
    schema = ("dataset string, family string, candidate_order int, fold int, "
              "balanced_accuracy double, roc_auc double, status string")
    folds = spark.createDataFrame(rows, schema)
    means = trials.trial_means(folds, ["dataset"], 3)
    best = trials.select_candidate(means, ["dataset"]).first()["selected_candidate_order"]
    want = min(scores, key=lambda o: (-(sum(scores[o]) / 3), o))
    assert best == want
    failed = folds.withColumn(
        "status", F.when((F.col("candidate_order") == 9) & (F.col("fold") == 2), "failure")
        .otherwise("success")
    )
    row = trials.select_candidate(trials.trial_means(failed, ["dataset"], 3), ["dataset"]).first()
    assert not row["all_trials_completed"] and row["selected_candidate_order"] is None


def test_grids_and_candidates(spark):
    assert (len(grid("GBDT")), len(grid("DNN"))) == (54, 27)
    trees = candidates("GBDT", FULL.candidate_count)
    assert trees[0] == {"learning_rate": 0.1, "max_leaf_nodes": 31, "l2_regularization": 0.0,
                        "min_samples_leaf": 20}
    assert trees[1] == {"learning_rate": 0.1, "max_leaf_nodes": 31, "l2_regularization": 1.0,
                        "min_samples_leaf": 40}
    nets = candidates("DNN", SMOKE.candidate_count)
    assert nets[1] == {"hidden_layer_sizes": (128, 64), "alpha": 0.001,
                       "learning_rate_init": 0.0003}
    assert trials.grid_without_baseline(spark, "GBDT").count() == 53
    assert trials.candidate_table(spark, FULL).count() == 40
    assert trials.protocol_table(spark, [FULL, SMOKE]).count() == 2
