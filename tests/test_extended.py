"""Running totals, entity splits, bootstrap, fold statistics, column shape and sparse encoding."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairgauge.frame import LabelledFrame
from pairgauge.functions.ranks import running_totals, value_levels
from pairgauge.operators import audit, entity_splits, fold_stats, prep, resample, scoring, shape, sparse, splits
from pairgauge.plans import catalogue, extended, transfer

from . import compare

SF = "/root/testdata/sf0.001"
NEW = sorted({**transfer.SQL, **extended.SQL})


@pytest.fixture(scope="module")
def duck():
    return compare.duck(SF)


@pytest.mark.parametrize("name", NEW)
def test_matches_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    sql = catalogue.statements()[name]
    assert compare.spark_rows(df) == compare.duck_rows(duck, sql)
    assert compare.spark_kinds(df) == compare.duck_kinds(duck, sql)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan


# --- running totals ------------------------------------------------------------------------


def test_running_totals_over_levels_of_values(spark):
    rng = random.Random(1)
    values = [0.0, -0.5, 1e-9, -1e9, 3.25, 3.25, 1e300] + [rng.uniform(-100, 100) for _ in range(400)]
    rows = [(f"k{k % 3}", v, rng.randrange(1, 9), rng.randrange(5)) for k, v in enumerate(sorted(set(values)))]
    df = spark.createDataFrame(rows, "key string, value double, n int, m int").repartition(5)
    got = running_totals(df, ["key"], ["n", "m"], value_levels(F.col("value")), [F.col("value")])
    found = {(r.key, r.value): (r.n__before, r.m__before) for r in got.collect()}
    upto = defaultdict(lambda: [0, 0])
    for key, value, n, m in sorted(rows, key=lambda r: r[1]):
        assert found[key, value] == tuple(upto[key])
        upto[key][0] += n
        upto[key][1] += m


def test_levels_of_values_grow_with_them(spark):
    rng = random.Random(2)
    values = sorted({rng.choice([-1, 1]) * rng.random() * 10.0 ** rng.randrange(-30, 30) for _ in range(2000)} | {0.0, 1.0, 2.0, 4.0, 0.5, -8.0})
    df = spark.createDataFrame([(v,) for v in values], "v double").select("v", *value_levels(F.col("v")))
    levels = [tuple(r[1:]) for r in df.collect()]
    assert levels == sorted(levels)


# --- entities ------------------------------------------------------------------------------


def _entity_rows(seed, n=600):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        entity = rng.choice([0, 0, 0, rng.randrange(40), None if k % 50 == 0 else 7])
        rows.append((f"d{k % 2}", entity, k, f"2024-01-{rng.randrange(1, 28):02d} {rng.randrange(24):02d}:00:00"))
    return rows


@pytest.fixture(scope="module")
def visits(spark):
    df = spark.createDataFrame(_entity_rows(3), "dataset string, entity int, row_id int, at string")
    return df.withColumn("time", F.to_timestamp("at")).drop("at")


def test_entities_stay_in_one_block_of_fair_size(visits):
    blocks = entity_splits.entity_blocks(visits, 4).collect()
    sizes, largest = Counter(), Counter()
    assert len({(r.dataset, r.entity) for r in blocks}) == len(blocks)
    for r in blocks:
        assert 0 <= r.block < 4
        sizes[r.dataset, r.block] += r.n_rows
        largest[r.dataset] = max(largest[r.dataset], r.n_rows)
    for (dataset, _), size in sizes.items():
        total = sum(n for (d, _), n in sizes.items() if d == dataset)
        assert abs(size - total / 4) <= largest[dataset]
    rows = entity_splits.assigned(visits, entity_splits.entity_blocks(visits, 4))
    assert rows.count() == visits.count()
    again = entity_splits.entity_blocks(visits.repartition(9), 4).collect()
    assert sorted(map(str, again)) == sorted(map(str, blocks))
    other = entity_splits.entity_blocks(visits, 4, seed=7).collect()
    assert sorted(map(str, other)) != sorted(map(str, blocks))


def test_time_keeps_entities_on_one_side(visits):
    sides = entity_splits.time_sides(visits, "time", 25).collect()
    for dataset in ("d0", "d1"):
        mine = [r for r in sides if r.dataset == dataset]
        train = [r for r in mine if r.part == "train"]
        test = [r for r in mine if r.part == "test"]
        assert train and test and max(r["last"] for r in train) <= min(r["last"] for r in test)
        total = sum(r.n_rows for r in mine)
        aim = total - -(-total * 25 // 100)
        assert aim - max(r.n_rows for r in mine) < sum(r.n_rows for r in train) <= aim
    assert entity_splits.time_sides(visits.where("false"), "time").count() == 0


# --- bootstrap -----------------------------------------------------------------------------


def test_draws_hold_as_many_families_as_there_are(spark):
    families = spark.createDataFrame([(f"f{k}",) for k in range(11)], "family string")
    drawn = resample.picked_families(families, 50)
    assert {r["sum(copies)"] for r in drawn.groupBy("draw").sum("copies").collect()} == {11}
    again = resample.picked_families(families.repartition(5), 50)
    assert sorted(map(tuple, drawn.collect())) == sorted(map(tuple, again.collect()))
    other = resample.picked_families(families, 50, seed=43)
    assert sorted(map(tuple, drawn.collect())) != sorted(map(tuple, other.collect()))


def test_intervals_match_numpy(spark):
    rng = random.Random(4)
    rows = [(f"f{rng.randrange(6)}", rng.uniform(-0.05, 0.05), rng.random(), rng.random()) for _ in range(40)]
    df = spark.createDataFrame(rows, "family string, predicted_gap double, low double, high double")
    got = {r.margin: r for r in resample.family_bootstrap(df, "low", "high", (0.0, 0.02), 200).collect()}
    names = sorted({r[0] for r in rows})
    copies = defaultdict(Counter)
    for r in resample.picked_families(df.select("family").distinct(), 200).collect():
        copies[r.draw][r.family] = r.copies
    for margin in (0.0, 0.02):
        regret = {f: [max(a, b) - (b if g > margin else a) for n, g, a, b in rows if n == f] for f in names}
        every = [x for f in names for x in regret[f]]
        means = [
            sum(c[f] * sum(regret[f]) for f in names) / sum(c[f] * len(regret[f]) for f in names) for c in copies.values()
        ]
        row = got[margin]
        assert row.n_datasets == 40 and row.n_families == len(names)
        assert np.isclose(row.mean_regret, np.mean(every))
        assert np.allclose([row.mean_regret_low, row.mean_regret_high], np.percentile(means, [2.5, 97.5]))
    alone = df.withColumn("family", F.lit("only"))
    one = resample.family_bootstrap(alone, "low", "high", (0.0,), 20).first()
    assert np.isclose(one.mean_regret_low, one.mean_regret) and np.isclose(one.mean_regret_high, one.mean_regret)


# --- fold statistics -----------------------------------------------------------------------


def test_fold_statistics_match_numpy(spark):
    rng = random.Random(5)
    rows = []
    for k in range(300):
        a = None if rng.random() < 0.1 else round(rng.gauss(0, 3), 1)
        b = 1e6 + rng.random() if rng.random() < 0.97 else None
        rows.append((f"d{k % 2}", k % 3, a, b, 4.0, None, rng.choice([0.0, -0.0])))
    names = ["a", "b", "flat", "hollow", "zero"]
    df = spark.createDataFrame(rows, "dataset string, fold int, " + ", ".join(f"{c} double" for c in names))
    got = {(r.dataset, r.fold, r.column): r for r in fold_stats.fold_statistics(df.repartition(6), ["dataset"], names, 3).collect()}
    assert len(got) == 2 * 3 * len(names)
    for dataset in ("d0", "d1"):
        for fold in range(3):
            mine = [r for r in rows if r[0] == dataset and r[1] != fold]
            for i, c in enumerate(names):
                cells = [r[2 + i] for r in mine]
                seen = [v for v in cells if v is not None]
                median = float(np.median(seen)) if seen else 0.0
                filled = np.array([median if v is None else v for v in cells])
                row = got[dataset, fold, c]
                assert (row.n_rows, row.n_missing) == (len(cells), len(cells) - len(seen))
                assert row.has_indicator == (len(seen) < len(cells)) and row.median == median
                assert np.isclose(row.imputed_mean, filled.mean(), rtol=1e-12, atol=1e-12)
                scale = filled.std() if len(set(filled.tolist())) > 1 else 1.0
                assert np.isclose(row.scale, scale, rtol=1e-7)


# --- shape ---------------------------------------------------------------------------------


def test_fold_statistics_of_windows_and_of_levels_agree(spark):
    rng = random.Random(8)
    rows = [(f"d{k % 2}", k % 3, rng.choice([None, rng.randrange(12) / 4]), rng.uniform(-5, 5)) for k in range(300)]
    df = spark.createDataFrame(rows, "dataset string, fold int, a double, b double")
    got = [
        {tuple(r)[:3]: tuple(r)[3:] for r in fold_stats.fold_statistics(df, ["dataset"], ["a", "b"], 3, listed=n).collect()}
        for n in (1, 50, 1000)
    ]
    assert got[0].keys() == got[1].keys() == got[2].keys() and len(got[0]) == 12
    for k, v in got[0].items():
        assert np.allclose(v, got[1][k], atol=1e-12) and np.allclose(v, got[2][k], atol=1e-12)


def test_tails_are_stable_far_from_zero(spark):
    rng = np.random.default_rng(6)
    x = rng.exponential(1.0, 4000)
    rows = [(f"d{k % 2}", float(v + 1e6), float(v), 1.0, 1) for k, v in enumerate(x)]
    df = spark.createDataFrame(rows, "dataset string, far double, near double, flat double, y int")
    far = {r.dataset: r for r in shape.tails(LabelledFrame(df, ("far", "flat"), ())).collect()}
    near = {r.dataset: r for r in shape.tails(LabelledFrame(df, ("near",), ())).collect()}
    for k in ("d0", "d1"):
        assert far[k].n_columns == 1
        assert np.isclose(far[k].median_abs_skew, near[k].median_abs_skew, rtol=1e-6)
        assert np.isclose(far[k].p90_kurtosis, near[k].p90_kurtosis, rtol=1e-6)
    none = shape.tails(LabelledFrame(df, ("flat",), ())).first()
    assert none.n_columns == 0 and none.median_abs_skew is None


def test_correlations_of_many_columns(spark):
    rng = np.random.default_rng(7)
    width, n = 220, 60
    x = rng.normal(size=(n, width)) + 1e5
    x[:, 5] = x[:, 4] * 3
    x[:, 6] = 2.0
    x[rng.random((n, width)) < 0.05] = np.nan
    names = [f"c{k}" for k in range(width)]
    rows = [("only", *[None if np.isnan(v) else float(v) for v in r], 1) for r in x]
    df = spark.createDataFrame(rows, "dataset string, " + ", ".join(f"{c} double" for c in names) + ", y int")
    lf = LabelledFrame(df.repartition(3), tuple(names), ())
    got = {(r.i, r.j): r for r in shape.pair_correlations(lf, block=64).collect()}
    assert len(got) == width * (width - 1) // 2
    for i, j in [(0, 1), (4, 5), (5, 6), (63, 64), (10, 219), (100, 150), (218, 219)]:
        both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
        assert got[i, j].n == both.sum()
        if 6 in (i, j):
            assert got[i, j].correlation is None
        else:
            assert np.isclose(got[i, j].correlation, np.corrcoef(x[both, i], x[both, j])[0, 1], atol=1e-9)
    summary = shape.correlation_summary(lf, block=64).first()
    assert np.isclose(summary.max_abs_correlation, 1.0) and summary.n_pairs == len(got) - (width - 1)


def test_levels_of_datasets_are_counted_apart(spark):
    rows = [("a", "x", None), ("a", "x", None), ("a", "y", None), ("b", None, "q"), ("b", "z", "q")]
    df = spark.createDataFrame(rows, "dataset string, one string, two string").withColumn("y", F.lit(1))
    lf = LabelledFrame(df, (), ("one", "two"))
    got = {(r.dataset, r.column): r.n_levels for r in shape.cardinalities(lf).collect()}
    assert got == {("a", "one"): 2, ("a", "two"): 0, ("b", "one"): 1, ("b", "two"): 1}
    assert shape.cardinality_summary(lf, many=1).where("dataset = 'a'").first().share_many_levels == 0.5


# --- sparse --------------------------------------------------------------------------------


@pytest.mark.parametrize("scaled", [False, True])
def test_sparse_rows_equal_dense_ones(spark, scaled):
    rng = random.Random(8)
    rows = [
        (f"d{k % 2}", f"r{k}", rng.choice([None, 0.0, 1.5, 2.0]), float(rng.randrange(5)), rng.choice([None, "x", "y"]), f"id{k}" if k % 5 else "id0", k % 4 > 0, 1)
        for k in range(80)
    ]
    df = spark.createDataFrame(rows, "dataset string, row_id string, a double, b double, c string, d string, train boolean, y int")
    lf = LabelledFrame(df, ("a", "b"), ("c", "d"))
    train = lf.with_df(df.where("train"))
    known = sparse.dictionary(train)
    dense = prep.long_form(prep.encode(lf, train, prep.fit(train), scaled=scaled), ("dataset",))
    want = {(r.dataset, r.row_id, r.position): (r.name, r.value) for r in dense.collect() if r.value != 0}
    names = {(r.dataset, r["index"]): r.name for r in known.collect()}
    found = sparse.entries(lf, known, scaled=scaled)
    got = {(r.dataset, r.row_id, r["index"]): (names[r.dataset, r["index"]], r.value) for r in found.collect()}
    assert got.keys() == want.keys()
    for k in want:
        assert got[k][0] == want[k][0] and np.isclose(got[k][1], want[k][1], atol=1e-12)
    packed = sparse.vectors(found, known).where("row_id = 'r1'").first()
    assert packed["indices"] == sorted(packed["indices"]) and packed["size"] == sum(k[0] == "d1" for k in names)


def test_sparse_rows_meet_the_dictionary_once(spark):
    rng = random.Random(12)
    rows = [(f"d{k % 2}", f"r{k}", rng.choice([None, 2.0, 0.0]), rng.choice([None, "u", "v"]), f"x{rng.randrange(30)}", k < 90, k % 2) for k in range(120)]
    df = spark.createDataFrame(rows, "dataset string, row_id string, a double, c string, d string, train boolean, y int")
    lf = LabelledFrame(df, ("a",), ("c", "d"))
    known = sparse.dictionary(lf.with_df(df.where("train")))
    found = [Counter(tuple(r) for r in sparse.entries(lf, known, listed=n).collect()) for n in (0, 5, 1024)]
    assert found[0] == found[1] == found[2] and max(found[0].values()) == 1
    # Rows, not cells, are joined: the cells come after the join.
    text = sparse.entries(lf, known)._jdf.queryExecution().optimizedPlan().toString()
    assert text.index("Generate explode(filter(array(") < text.index("Join Inner")


# --- absent kinds of columns, records ----------------------------------------------------


def test_absent_kinds_of_columns_give_nulls(spark):
    df = spark.createDataFrame([("a", 1.0, "x", 0), ("a", 2.0, "y", 1), ("b", None, None, 1)], "dataset string, v double, c string, y int")
    only_text, only_number = LabelledFrame(df, (), ("c",)), LabelledFrame(df, ("v",), ())
    levels = shape.cardinality_summary(only_number).collect()
    assert len(levels) == 2 and all(r.mean_levels is None and r.max_levels is None for r in levels)
    assert all(r.n_columns == 0 and r.p90_kurtosis is None for r in shape.tails(only_text).collect())
    # Two values are too few for skew.
    assert all(r.median_abs_skew is None for r in shape.tails(only_number).collect())
    pairs = shape.correlation_summary(only_number).collect()
    assert len(pairs) == 2 and all(r.n_pairs == 0 and r.share_strong is None for r in pairs)
    got = {r.dataset: r for r in shape.basic_extras(only_number).collect()}
    assert got["a"].n_binary == 1 and got["b"].n_binary == 0 and got["b"].zero_share is None
    assert np.isclose(got["a"].target_entropy, np.log(2)) and got["a"].relative_entropy == 1.0
    assert got["b"].target_entropy == 0 and got["b"].relative_entropy is None and got["b"].largest_gap_share == 1.0
    text = {r.dataset: r for r in shape.basic_extras(only_text).collect()}
    assert text["a"].n_binary == 1 and text["a"].median_log_variance is None


def test_surplus_duplicates_count_copies_beyond_the_first(spark):
    df = spark.createDataFrame([("d", "a", 0), ("d", "a", 1), ("d", "b", 1)], "dataset string, c string, y int")
    assert np.isclose(shape.basic_extras(LabelledFrame(df, (), ("c",))).first().surplus_duplicates, 1 / 3)


def test_audit_record(spark):
    rows = [("d", 1.0, None, "k", 0), ("d", 1.0, None, "k", 1), ("d", 2.0, 5.0, "k", 1), ("e", 1.0, 1.0, None, None)]
    df = spark.createDataFrame(rows, "dataset string, a double, b double, c string, y int")
    got = {r.dataset: r for r in audit.audit_record(LabelledFrame(df, ("a", "b"), ("c",))).collect()}
    d, e = got["d"], got["e"]
    assert (d.n_rows, d.n_features, d.missing_cells, d.missing_by_column) == (3, 3, 2, {"b": 2})
    assert d.class_counts == {0: 1, 1: 2} and d.constant_columns == ["c"]
    assert (d.duplicate_feature_rows, d.conflicting_target_signature_rows, d.exact_duplicate_rows) == (2, 2, 0)
    assert e.class_counts is None and e.constant_columns == ["a", "b", "c"] and e.missing_by_column == {"c": 1}
    assert d.notes == audit.AUDIT_NOTE


@pytest.mark.parametrize("most", [3, 1000])
def test_area_under_the_curve_by_levels(spark, most):
    rng = random.Random(9)
    rows = [("a", rng.choice([0.0, -0.0, rng.uniform(-1, 1), 0.25]), rng.randrange(2)) for _ in range(200)]
    rows += [("one", 0.5, 1), ("bad", float("nan"), 1), ("bad", 0.3, 0), ("bad", float("inf"), 0), ("bad", 0.2, 0), ("bad", 0.1, 1)]
    df = spark.createDataFrame(rows, "key string, score double, y int")
    got = {r.key: r.roc_auc for r in scoring.roc_auc(df, ["key"], scores_per_task=most).collect()}
    mine = [(s, y) for k, s, y in rows if k == "a"]
    wins = sum((p > n) + 0.5 * (p == n) for p, a in mine if a for n, b in mine if not b)
    total = sum(y for _, y in mine) * sum(1 - y for _, y in mine)
    assert np.isclose(got["a"], wins / total, rtol=1e-12) and got["one"] is None and got["bad"] is None


def test_repeated_ids_are_told_and_left_out(spark):
    rows = [("good", f"r{k}", 1.0, k % 2) for k in range(20)]
    rows += [("twice", f"r{k % 15}", 1.0, k % 2) for k in range(20)] + [("none", None, 1.0, 1)]
    lf = LabelledFrame(spark.createDataFrame(rows, "dataset string, row_id string, v double, y int"), ("v",), ())
    got = {r.dataset: (r.n_rows, r.n_ids, r.repeated_rows, r.status) for r in splits.row_id_status(lf).collect()}
    assert got == {"good": (20, 20, 0, "ok"), "twice": (20, 15, 10, "repeated_row_id"), "none": (1, 1, 0, "missing_row_id")}
    kept = splits.assign_splits(lf, (42,), 0.25, 3, unique_ids=True)
    assert {(r.dataset, r.part): r["count"] for r in kept.groupBy("dataset", "part").count().collect()} == {
        ("good", "test"): 5, ("good", "train"): 15,
    }
