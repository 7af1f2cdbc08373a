"""Queries for column shape, fold statistics, entity splits and the bootstrap, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C
from ..frame import LabelledFrame
from ..operators import audit, entity_splits, fold_stats, profile, recommend, resample, shape, sparse, splits
from ..protocol import FULL
from ..session import stored
from ..sources.tables import read_table
from . import outcomes, tasks, transfer
from .oracle import _query, _r
from .queries import rounded

BLOCKS = 5
TEST_PERCENT = 25


def bootstrap_regret(spark: SparkSession, sf: str) -> DataFrame:
    """Margins of the held-out mean on the suppliers' measured scores, with intervals over nations."""
    meta = stored(outcomes.measured_meta(spark, sf)).withColumnRenamed(outcomes.GAP, C.GAP)
    told = recommend.dummy_predictions(meta)
    return rounded(resample.family_bootstrap(told, "score_vote", "score_centroid"))


def _buyers(spark: SparkSession, sf: str) -> DataFrame:
    """Orders by market segment: one dataset per segment, whose entities are the customers."""
    orders = read_table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    customers = read_table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    joined = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
    return joined.select(
        F.col("c_mktsegment").alias("dataset"), F.col("o_custkey").alias("entity"),
        F.col("o_orderkey").alias("row_id"), F.col("o_orderdate").alias("time"),
    )


def entity_folds(spark: SparkSession, sf: str) -> DataFrame:
    rows = _buyers(spark, sf)
    return entity_splits.assigned(rows.drop("time"), entity_splits.entity_blocks(rows, BLOCKS))


def entity_fold_sizes(spark: SparkSession, sf: str) -> DataFrame:
    blocks = entity_splits.entity_blocks(_buyers(spark, sf), BLOCKS)
    return blocks.groupBy("dataset", "block").agg(
        F.count(F.lit(1)).alias("n_entities"), F.sum("n_rows").alias("n_rows"), F.max("n_rows").alias("largest")
    )


def time_ordered_split(spark: SparkSession, sf: str) -> DataFrame:
    rows = _buyers(spark, sf)
    return entity_splits.assigned(rows.drop("time"), entity_splits.time_sides(rows, "time", TEST_PERCENT))


def _train_parts(spark: SparkSession, sf: str) -> LabelledFrame:
    lf = tasks.returns(spark, sf)
    rows = splits.assign_splits(lf, FULL.outer_seeds, FULL.test_size, FULL.inner_folds, carry=lf.features)
    return lf.with_df(rows.where("part = 'train'"), keys=("dataset", "outer_seed"))


def fold_statistics(spark: SparkSession, sf: str) -> DataFrame:
    """Medians, indicators and scales of every training set of every seed and fold."""
    lf = _train_parts(spark, sf)
    return rounded(fold_stats.fold_statistics(lf.df, lf.keys, lf.numeric, FULL.inner_folds))


def sampled_descriptors(spark: SparkSession, sf: str) -> DataFrame:
    """Descriptors of a table as its benchmark would record them, without any fit."""
    described = profile.characterize(_train_parts(spark, sf))
    return rounded(shape.sampled_descriptors(described, ("dataset",), C.DESCRIPTORS))


def _wide(spark: SparkSession, sf: str) -> LabelledFrame:
    """Lines with many levels, with columns that nearly repeat each other and a flat one."""
    lines = read_table(spark, sf, "lineitem")
    rows = lines.select(
        tasks.supplier_name(F.col("l_suppkey")).alias("dataset"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_extendedprice").alias("price"),
        F.nullif("l_discount", F.lit(0.0)).alias("discount"),
        F.nullif("l_tax", F.lit(0.0)).alias("tax"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"),
        (F.col("l_quantity") * F.col("l_quantity")).alias("square"),
        F.lit(7.0).alias("flat"),
        F.nullif("l_linestatus", F.lit("F")).alias("linestatus"),
        F.col("l_partkey").cast("string").alias("part"),
        F.date_format("l_shipdate", "yyyy-MM").alias("month"),
        (F.col("l_returnflag") == "R").cast("int").alias("y"),
    )
    return LabelledFrame(
        rows, ("quantity", "price", "discount", "tax", "net", "square", "flat"), ("linestatus", "part", "month")
    )


def column_cardinalities(spark: SparkSession, sf: str) -> DataFrame:
    return shape.cardinalities(_wide(spark, sf))


def cardinality_summary(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(shape.cardinality_summary(_wide(spark, sf)))


def column_tails(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(shape.tails(_wide(spark, sf)))


def correlation_summary(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(shape.correlation_summary(_wide(spark, sf)))


def _by_line_number(spark: SparkSession, sf: str) -> LabelledFrame:
    """Lines named by order and line number, which repeat for some suppliers."""
    lf = tasks.returns(spark, sf)
    return lf.with_df(lf.df.withColumn("row_id", F.concat_ws("-", *[F.split("row_id", "-")[k] for k in (0, 1)])))


def row_id_status(spark: SparkSession, sf: str) -> DataFrame:
    return splits.row_id_status(_by_line_number(spark, sf))


def basic_extras(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(shape.basic_extras(_wide(spark, sf)))


def audit_record(spark: SparkSession, sf: str) -> DataFrame:
    """The record as plain columns: maps and lists joined to text."""
    pairs = lambda c: F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat_ws(":", e["key"], e["value"])), ",")
    found = audit.audit_record(_wide(spark, sf)).drop("notes")
    return found.withColumns(
        {
            "class_counts": pairs("class_counts"),
            "missing_by_column": pairs("missing_by_column"),
            "constant_columns": F.array_join(F.array_sort("constant_columns"), ","),
        }
    )


def winner_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    """How the held-out mean does on the suppliers' measured scores, by who really won."""
    names = {outcomes.GAP: C.GAP, "score_vote": C.SCORE_GBDT, "score_centroid": C.SCORE_DNN}
    meta = stored(outcomes.measured_meta(spark, sf)).withColumnsRenamed(names)
    return rounded(recommend.winner_accuracy(recommend.evaluate(meta, recommend.dummy_predictions(meta))))


def _learned_and_all(spark: SparkSession, sf: str) -> tuple[LabelledFrame, LabelledFrame]:
    """Lines of every supplier; those shipped early train, later ones bring new parts and months."""
    lf = _wide(spark, sf)
    lines = read_table(spark, sf, "lineitem")
    rows = lines.select(
        tasks.supplier_name(F.col("l_suppkey")).alias("dataset"),
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", F.round(F.col("l_extendedprice") * 100).cast("bigint")).alias("row_id"),
        F.col("l_quantity").alias("quantity"),
        F.nullif("l_discount", F.lit(0.0)).alias("discount"),
        F.nullif("l_tax", F.lit(0.0)).alias("tax"),
        F.nullif("l_linestatus", F.lit("F")).alias("linestatus"),
        F.col("l_partkey").cast("string").alias("part"),
        F.date_format("l_shipdate", "yyyy-MM").alias("month"),
        (F.col("l_returnflag") == "R").cast("int").alias("y"),
        (F.col("l_shipdate") < F.lit(outcomes.LEARN_BEFORE)).alias("early"),
    )
    whole = LabelledFrame(rows, ("quantity", "discount", "tax"), lf.categorical)
    return whole.with_df(rows.where("early")), whole


def sparse_dictionary(spark: SparkSession, sf: str) -> DataFrame:
    """Every encoded column of every supplier, part numbers included."""
    train, _ = _learned_and_all(spark, sf)
    known = sparse.dictionary(train)
    return rounded(known.select("dataset", "kind", "column", "level", "index", "name", "fill"))


def sparse_design(spark: SparkSession, sf: str) -> DataFrame:
    """All lines encoded with what the early ones taught."""
    train, whole = _learned_and_all(spark, sf)
    return rounded(sparse.entries(whole, sparse.dictionary(train)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        bootstrap_regret,
        entity_folds,
        entity_fold_sizes,
        time_ordered_split,
        fold_statistics,
        sampled_descriptors,
        column_cardinalities,
        cardinality_summary,
        column_tails,
        correlation_summary,
        sparse_dictionary,
        sparse_design,
        basic_extras,
        audit_record,
        winner_accuracy,
        row_id_status,
    )
}

# --- SQL ----------------------------------------------------------------------------------

_BUYERS = """buyers AS (SELECT c_mktsegment AS dataset, o_custkey AS entity, o_orderkey AS row_id, o_orderdate AS time
        FROM orders JOIN customer ON o_custkey = c_custkey)"""
_BLOCKS = f"""WITH {_BUYERS},
    counted AS (SELECT dataset, entity, count(*) AS n, md5('42|' || entity) AS d FROM buyers GROUP BY ALL),
    blocks AS (SELECT dataset, entity, n, ((2 * (sum(n) OVER w - n) + n) * {BLOCKS} // (2 * sum(n) OVER (PARTITION BY dataset)))::INT AS block
      FROM counted WINDOW w AS (PARTITION BY dataset ORDER BY d, entity ROWS UNBOUNDED PRECEDING))"""
_WIDE = """wide AS (SELECT 'supplier-' || l_suppkey AS dataset, l_quantity AS quantity, l_extendedprice AS price,
        nullif(l_discount, 0) AS discount, nullif(l_tax, 0) AS tax, l_extendedprice * (1 - l_discount) AS net,
        l_quantity * l_quantity AS square, 7.0::DOUBLE AS flat, nullif(l_linestatus, 'F') AS linestatus,
        l_partkey::VARCHAR AS part, strftime(l_shipdate, '%Y-%m') AS month FROM lineitem)"""
_NUMERIC = ("quantity", "price", "discount", "tax", "net", "square", "flat")
_LEVELS = f"""WITH {_WIDE}, levels AS ({" UNION ALL ".join(
    f"SELECT dataset, '{c}' AS column, count(DISTINCT {c}) AS n_levels FROM wide GROUP BY dataset" for c in ("linestatus", "part", "month"))})"""


def _tails_sql() -> str:
    parts = " UNION ALL ".join(
        f"""SELECT dataset, abs(m3 / m2 ** 1.5) AS s, m4 / (m2 * m2) - 3 AS k FROM (SELECT dataset, avg(({c} - m) ** 2) AS m2,
            avg(({c} - m) ** 3) AS m3, avg(({c} - m) ** 4) AS m4, min({c}) AS low, max({c}) AS high
            FROM wide JOIN (SELECT dataset, avg({c}) AS m FROM wide GROUP BY dataset) USING (dataset) GROUP BY dataset HAVING count({c}) >= 4) WHERE low < high"""
        for c in _NUMERIC
    )
    return f"""WITH {_WIDE}, moments AS ({parts}) SELECT dataset, count(*)::INT AS n_columns,
        {_r("quantile_cont(s, 0.5)")} AS median_abs_skew, {_r("quantile_cont(s, 0.9)")} AS p90_abs_skew,
        {_r("quantile_cont(k, 0.5)")} AS median_kurtosis, {_r("quantile_cont(k, 0.9)")} AS p90_kurtosis
        FROM moments GROUP BY dataset"""


def _correlations_sql() -> str:
    pairs = " UNION ALL ".join(
        f"SELECT dataset, abs(corr({a}, {b})) AS c FROM wide GROUP BY dataset HAVING min({a}) < max({a}) AND min({b}) < max({b})"
        for i, a in enumerate(_NUMERIC) for b in _NUMERIC[i + 1 :]
    )
    return f"""WITH {_WIDE}, pairs AS ({pairs}) SELECT dataset, count(c) AS n_pairs, {_r("avg(c)")} AS mean_abs_correlation,
        {_r("max(c)")} AS max_abs_correlation, {_r("avg((c > 0.95)::INT)")} AS share_strong FROM pairs GROUP BY dataset"""


def _fold_sql() -> str:
    parts = " UNION ALL ".join(
        f"""SELECT dataset, outer_seed, f AS fold, '{c}' AS "column", {c} AS v FROM full_split JOIN range(3) AS r(f) ON f <> fold WHERE part = 'train'"""
        for c in ("quantity", "price", "discount", "tax")
    )
    return f"""SELECT dataset, outer_seed, fold::INT AS fold, "column", n_rows, n_missing, {_r("med")} AS median, n_missing > 0 AS has_indicator,
        {_r("m")} AS imputed_mean, {_r("CASE WHEN s = 0 THEN 1 ELSE s END")} AS scale FROM (
          SELECT dataset, outer_seed, fold, "column", count(*) AS n_rows, count(*) - count(v) AS n_missing, any_value(med) AS med,
            avg(coalesce(v, med)) AS m, stddev_pop(coalesce(v, med)) AS s
          FROM (SELECT *, coalesce(median(v) OVER (PARTITION BY dataset, outer_seed, fold, "column"), 0) AS med FROM ({parts}))
          GROUP BY dataset, outer_seed, fold, "column")"""


_INTERVALS = ", ".join(
    f"{_r(f'quantile_cont({v}, {q})')} AS {name}_{end}"
    for name, v in (("mean_regret", "regret / n"), ("accuracy", "hits / n"), ("mean_saved", "saved / n"))
    for end, q in (("low", 0.025), ("high", 0.975))
)

_SPARSE = f"""WITH rows_ AS (SELECT 'supplier-' || l_suppkey AS dataset,
        concat_ws('-', l_orderkey, l_linenumber, l_partkey, round(l_extendedprice * 100)::BIGINT) AS row_id,
        l_quantity AS quantity, nullif(l_discount, 0) AS discount, nullif(l_tax, 0) AS tax,
        coalesce(nullif(l_linestatus, 'F'), '__missing__') AS linestatus, l_partkey::VARCHAR AS part,
        strftime(l_shipdate, '%Y-%m') AS month, l_shipdate < TIMESTAMP '{outcomes.LEARN_BEFORE}' AS early FROM lineitem),
    early AS (SELECT * FROM rows_ WHERE early),
    known AS ({" UNION ALL ".join(
        [f"SELECT dataset, 'value' AS kind, '{c}' AS col, NULL::VARCHAR AS level, 0 AS block, {i} AS place, '{c}' AS name, coalesce(median({c}), 0) AS fill FROM early GROUP BY dataset" for i, c in enumerate(("quantity", "discount", "tax"))]
        + [f"SELECT dataset, 'gap', '{c}', NULL, 1, {i}, 'missingindicator_{c}', NULL FROM early GROUP BY dataset HAVING count(*) > count({c})" for i, c in enumerate(("quantity", "discount", "tax"))]
        + [f"SELECT DISTINCT dataset, 'level', '{c}', {c}, 2, {i}, '{c}_' || {c}, NULL FROM early" for i, c in enumerate(("linestatus", "part", "month"))]
    )}),
    dict AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY block, place, level) - 1 AS index FROM known),
    cells AS ({" UNION ALL ".join(
        [f"SELECT dataset, row_id, 'value' AS kind, '{c}' AS col, NULL::VARCHAR AS level, {c} AS value FROM rows_" for c in ("quantity", "discount", "tax")]
        + [f"SELECT dataset, row_id, 'gap', '{c}', NULL, 1.0 FROM rows_ WHERE {c} IS NULL" for c in ("quantity", "discount", "tax")]
        + [f"SELECT dataset, row_id, 'level', '{c}', {c}, 1.0 FROM rows_" for c in ("linestatus", "part", "month")]
    )})"""

_FEATURES = (*_NUMERIC, "linestatus", "part", "month")
_GAPS = [f"(count(*) - count({c}))" for c in _FEATURES]
_EXTRAS = f"""WITH {_WIDE.replace("AS month FROM", "AS month, (l_returnflag = 'R')::INT AS y FROM")},
    binaries AS (SELECT dataset, {" + ".join(f"(count(DISTINCT {c}) = 2)::INT" for c in _FEATURES)} AS n_binary FROM wide GROUP BY dataset),
    spreads AS ({" UNION ALL ".join(f"SELECT dataset, var_pop({c}) AS m2, avg({c} * {c}) AS q FROM wide GROUP BY dataset" for c in _NUMERIC)}),
    spread AS (SELECT dataset, quantile_cont(ln(1 + m2), 0.5) AS v, avg((m2 / (q + 1e-12) < 1e-8)::INT) AS still FROM spreads GROUP BY dataset),
    entropy AS (SELECT dataset, -sum(q * ln(q)) AS e, count(*) AS k FROM (SELECT dataset, y, count(*) / sum(count(*)) OVER (PARTITION BY dataset) AS q
      FROM wide GROUP BY dataset, y) GROUP BY dataset),
    plain AS (SELECT dataset, count(*) AS n, ({" + ".join(f"({g} > 0)::INT" for g in _GAPS)}) / {len(_FEATURES)}.0 AS gap_columns,
      greatest({", ".join(_GAPS)}) / count(*)::DOUBLE AS largest, ({" + ".join(f"count(*) FILTER ({c} = 0)" for c in _NUMERIC)})::DOUBLE
        / ({" + ".join(f"count({c})" for c in _NUMERIC)}) AS zeros FROM wide GROUP BY dataset),
    sigs AS (SELECT dataset, (sum(c) - count(*))::DOUBLE / sum(c) AS surplus FROM (SELECT dataset, count(*) AS c FROM wide
      GROUP BY dataset, {", ".join(_FEATURES)}) GROUP BY dataset)"""

SQL: dict[str, str] = {
    "row_id_status": """SELECT dataset, sum(n)::BIGINT AS n_rows, count(*) AS n_ids, coalesce(sum(n) FILTER (n > 1), 0)::BIGINT AS repeated_rows,
        CASE WHEN max(n) > 1 THEN 'repeated_row_id' ELSE 'ok' END AS status
        FROM (SELECT 'supplier-' || l_suppkey AS dataset, l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL) GROUP BY dataset""",
    "basic_extras": _EXTRAS + f""" SELECT dataset, {_r("ln(1 + n)")} AS log_rows, {_r(f"ln(1 + {len(_FEATURES)})")} AS log_features,
        {len(_NUMERIC)}::INT AS n_numeric, 3::INT AS n_categorical, n_binary::BIGINT AS n_binary, {_r("gap_columns::DOUBLE")} AS gap_columns_share,
        {_r("largest")} AS largest_gap_share, {_r("e")} AS target_entropy, CASE WHEN k > 1 THEN {_r("e / ln(k)")} END AS relative_entropy,
        {_r("v")} AS median_log_variance, {_r("still")} AS near_constant_share, {_r("surplus")} AS surplus_duplicates, {_r("zeros")} AS zero_share
        FROM plain JOIN binaries USING (dataset) JOIN spread USING (dataset) JOIN entropy USING (dataset) JOIN sigs USING (dataset)""",
    "audit_record": _EXTRAS + f""", groups AS (SELECT dataset, count(*) AS n, count(*) FILTER (y = 0) AS n0, count(*) FILTER (y = 1) AS n1
          FROM wide GROUP BY dataset, {", ".join(_FEATURES)}),
        dup AS (SELECT dataset, sum(n)::BIGINT AS n_rows, coalesce(sum(n) FILTER (n > 1), 0)::BIGINT AS duplicate_feature_rows,
          count(*) FILTER (n > 1) AS duplicate_feature_groups,
          (coalesce(sum(n0) FILTER (n0 > 1), 0) + coalesce(sum(n1) FILTER (n1 > 1), 0))::BIGINT AS exact_duplicate_rows,
          count(*) FILTER (n0 > 1) + count(*) FILTER (n1 > 1) AS exact_duplicate_groups,
          coalesce(sum(n) FILTER (n0 > 0 AND n1 > 0), 0)::BIGINT AS conflicting_target_signature_rows,
          count(*) FILTER (n0 > 0 AND n1 > 0) AS conflicting_target_signature_groups FROM groups GROUP BY dataset),
        gaps AS (SELECT dataset, ({" + ".join(_GAPS)})::BIGINT AS missing_cells,
          concat_ws(',', {", ".join(f"CASE WHEN {g} > 0 THEN '{c}:' || {g} END" for c, g in sorted(zip(_FEATURES, _GAPS, strict=True)))}) AS missing_by_column,
          concat_ws(',', {", ".join(f"CASE WHEN count(DISTINCT {c}) + (count(*) > count({c}))::INT <= 1 THEN '{c}' END" for c in sorted(_FEATURES))}) AS constant_columns,
          concat_ws(',', CASE WHEN min(y) = 0 THEN '0:' || count(*) FILTER (y = 0) END, CASE WHEN max(y) = 1 THEN '1:' || count(*) FILTER (y = 1) END) AS class_counts
          FROM wide GROUP BY dataset)
        SELECT *, {len(_FEATURES)}::BIGINT AS n_features FROM dup JOIN gaps USING (dataset)""",
    "winner_accuracy": transfer._WITH + f""",
        sums AS (SELECT family, count(*) AS n, sum(gap) AS g FROM measured GROUP BY family),
        told AS (SELECT m.*, ((SELECT sum(g) FROM sums) - g) / ((SELECT sum(n) FROM sums) - n) AS predicted FROM measured AS m JOIN sums USING (family)),
        hits AS (SELECT gap, predicted, gap > 0 AS high, ((predicted > 0.01) = (gap > 0))::INT AS hit FROM told)
        SELECT count(*) AS n_datasets, {_r("avg(abs(predicted - gap))")} AS mae_gap, count(*) FILTER (NOT high) AS wins_gbdt, count(*) FILTER (high) AS wins_dnn,
          {_r("avg(hit) FILTER (NOT high)")} AS accuracy_gbdt, {_r("avg(hit) FILTER (high)")} AS accuracy_dnn,
          {_r("(avg(hit) FILTER (NOT high) + avg(hit) FILTER (high)) / 2")} AS balanced_accuracy FROM hits""",
    "sparse_dictionary": _SPARSE + f""" SELECT dataset, kind, col AS "column", level, index, name, {_r("fill")} AS fill FROM dict""",
    "sparse_design": _SPARSE + f""" SELECT c.dataset, row_id, index, {_r("coalesce(value, fill)")} AS value
        FROM cells AS c JOIN dict AS d ON c.dataset = d.dataset AND c.kind = d.kind AND c.col = d.col
          AND c.level IS NOT DISTINCT FROM d.level WHERE coalesce(value, fill) <> 0""",
    "bootstrap_regret": transfer._WITH + f""",
        sums AS (SELECT family, count(*) AS n, sum(gap) AS g FROM measured GROUP BY family),
        told AS (SELECT m.*, ((SELECT sum(g) FROM sums) - g) / ((SELECT sum(n) FROM sums) - n) AS predicted
                 FROM measured AS m JOIN sums USING (family)),
        each AS (SELECT family, margin, greatest(score_vote, score_centroid)
                   - CASE WHEN predicted > margin THEN score_centroid ELSE score_vote END AS regret,
                   greatest(score_vote, score_centroid) - score_vote AS low_regret,
                   ((predicted > margin) = (score_centroid > score_vote))::INT AS hit
                 FROM told, (VALUES (0.0::DOUBLE), (0.005::DOUBLE), (0.01::DOUBLE), (0.02::DOUBLE)) AS v(margin)),
        per AS (SELECT family, margin, count(*) AS n, sum(regret) AS regret, sum(low_regret - regret) AS saved, sum(hit) AS hits
                FROM each GROUP BY ALL),
        named AS (SELECT family, row_number() OVER (ORDER BY family) - 1 AS place, count(*) OVER () AS f FROM sums),
        picks AS (SELECT draw, ('0x' || md5('42|' || draw || '|' || slot)[1:15])::BIGINT % f AS place
                  FROM range(2000) AS d(draw), (SELECT place AS slot, f FROM named)),
        drawn AS (SELECT margin, draw, sum(n)::DOUBLE AS n, sum(regret) AS regret, sum(saved) AS saved, sum(hits) AS hits
                  FROM picks JOIN named USING (place) JOIN per USING (family) GROUP BY ALL),
        spread AS (SELECT margin, {_INTERVALS} FROM drawn GROUP BY margin)
        SELECT {_r("margin")} AS margin, n_datasets, n_families, mean_regret, accuracy, mean_saved, spread.* EXCLUDE (margin) FROM (
          SELECT margin, sum(n)::BIGINT AS n_datasets, count(*) AS n_families, {_r("sum(regret) / sum(n)")} AS mean_regret,
            {_r("sum(hits) / sum(n)")} AS accuracy, {_r("sum(saved) / sum(n)")} AS mean_saved FROM per GROUP BY margin) JOIN spread USING (margin)""",
    "entity_folds": _BLOCKS + " SELECT b.dataset, b.entity, row_id, block FROM buyers AS b JOIN blocks USING (dataset, entity)",
    "entity_fold_sizes": _BLOCKS + """ SELECT dataset, block, count(*) AS n_entities, sum(n)::BIGINT AS n_rows, max(n) AS largest
        FROM blocks GROUP BY ALL""",
    "time_ordered_split": f"""WITH {_BUYERS},
        counted AS (SELECT dataset, entity, count(*) AS n, max(time) AS last, md5('42|' || entity) AS d FROM buyers GROUP BY ALL),
        sides AS (SELECT dataset, entity, CASE WHEN sum(n) OVER (PARTITION BY dataset ORDER BY date_trunc('second', last), d, entity ROWS UNBOUNDED PRECEDING)
              <= total - ceil(total * {TEST_PERCENT} / 100.0) THEN 'train' ELSE 'test' END AS part
          FROM counted JOIN (SELECT dataset, sum(n) AS total FROM counted GROUP BY dataset) USING (dataset))
        SELECT b.dataset, b.entity, row_id, part FROM buyers AS b JOIN sides USING (dataset, entity)""",
    "fold_statistics": _fold_sql(),
    "sampled_descriptors": f"""SELECT dataset, 3::BIGINT AS n_samples_drawn, {", ".join(_r(d) + f" AS {d}" for d in C.DESCRIPTORS)}
        FROM meta_descriptors""",
    "column_cardinalities": _LEVELS + " SELECT * FROM levels",
    "cardinality_summary": _LEVELS + f""" SELECT dataset, {_r("avg(n_levels)")} AS mean_levels, max(n_levels) AS max_levels,
        {_r("avg((n_levels > 20)::INT)")} AS share_many_levels FROM levels GROUP BY dataset""",
    "column_tails": _tails_sql(),
    "correlation_summary": _correlations_sql(),
}


def statements() -> dict[str, str]:
    return {name: text if text.lstrip().startswith("WITH") else _query(text) for name, text in SQL.items()}
