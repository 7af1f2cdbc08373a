"""Recommendations for tables that were not there when a model was trained, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C
from ..operators import models, recommend, trees
from ..session import stored
from . import outcomes
from .oracle import RET_CATEGORICAL, RET_NUMERIC, _describe, _evaluation, _query, _r
from .queries import rounded

FEATURES = list(C.DESCRIPTORS)


def measured_meta(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(outcomes.measured_meta(spark, sf))


def _learned(spark: SparkSession, sf: str) -> DataFrame:
    return stored(outcomes.measured_meta(spark, sf))


def _told(spark: SparkSession, sf: str, kind: str, by: str | None) -> DataFrame:
    fitted = models.train(_learned(spark, sf), kind, FEATURES, outcomes.GAP, by)
    told = models.predict(stored(fitted), outcomes.new_tables(spark, sf), FEATURES, by, labels=outcomes.LABELS)
    return rounded(told.select("dataset", "region", "predicted_gap", "recommendation"))


def recommend_new_mean(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers of a region train; the tables of its buyers are told apart from them."""
    return _told(spark, sf, "dummy_mean", "region")


def recommend_new_ridge(spark: SparkSession, sf: str) -> DataFrame:
    """One ridge over the ten descriptors of all suppliers, applied to the tables of buyers."""
    return _told(spark, sf, "ridge", None)


def recommend_new_ridge_by_region(spark: SparkSession, sf: str) -> DataFrame:
    return _told(spark, sf, "ridge", "region")


def recommend_new_tree(spark: SparkSession, sf: str) -> DataFrame:
    return _told(spark, sf, "decision_tree", "region")


def recommend_new_forest(spark: SparkSession, sf: str) -> DataFrame:
    return _told(spark, sf, "random_forest", None)


def fitted_models(spark: SparkSession, sf: str) -> DataFrame:
    """The model table itself: rows, status, intercept and centres of each region's ridge."""
    fitted = models.train(_learned(spark, sf), "ridge", FEATURES, outcomes.GAP, "region")
    center = [F.col("centers")[i].alias(f"center_{c}") for i, c in enumerate(FEATURES)]
    return rounded(fitted.select("model", "kind", "status", "n_rows", "intercept", *center))


def _held_out(spark: SparkSession, sf: str, kind: str) -> DataFrame:
    """Each supplier's gap as told by the trees grown without its nation."""
    meta = _learned(spark, sf)
    rows = stored(
        meta.select(
            F.lit(trees.ALL).alias("group"), "dataset", F.col("family").alias("fold"),
            F.col(outcomes.GAP).alias("y"), *FEATURES,
        )
    )
    _, told = trees.grow(rows, FEATURES, trees.SHAPES[kind], rows.select("group", "fold").distinct())
    joined = meta.select("dataset", "family", outcomes.GAP).join(told.drop("group"), "dataset")
    return rounded(joined.withColumnRenamed("predicted", "predicted_gap"))


def held_out_ridge(spark: SparkSession, sf: str) -> DataFrame:
    """Each supplier's gap as told by the ridge over the ten descriptors of the other nations."""
    meta = _learned(spark, sf).withColumnRenamed(outcomes.GAP, C.GAP)
    told = recommend.ridge_predictions(meta, FEATURES).withColumnRenamed(C.GAP, outcomes.GAP)
    return rounded(told.select("dataset", "family", outcomes.GAP, "predicted_gap"))


def held_out_tree(spark: SparkSession, sf: str) -> DataFrame:
    return _held_out(spark, sf, "decision_tree")


def held_out_forest(spark: SparkSession, sf: str) -> DataFrame:
    return _held_out(spark, sf, "random_forest")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        measured_meta,
        fitted_models,
        recommend_new_mean,
        recommend_new_ridge,
        recommend_new_ridge_by_region,
        recommend_new_tree,
        recommend_new_forest,
        held_out_ridge,
        held_out_tree,
        held_out_forest,
    )
}

# --- SQL ----------------------------------------------------------------------------------

_RAW = _describe("{source}", "dataset", RET_NUMERIC, RET_CATEGORICAL)


def _exact(described: str) -> str:
    """Descriptors without rounding."""
    import re

    return re.sub(r"round\((.*) \+ 1e-10, 6\) \+ 0\.0", r"\1", described)


_BALANCED = """(count(*) FILTER (y = 0 AND NOT guess) / nullif(count(*) FILTER (y = 0), 0)::DOUBLE
              + count(*) FILTER (y = 1 AND guess) / nullif(count(*) FILTER (y = 1), 0)::DOUBLE) / 2"""

_CTES = f"""
    lines AS (SELECT 'supplier-' || l_suppkey AS dataset, l_quantity AS q, l_extendedprice AS p, l_linestatus AS ls,
                (l_returnflag = 'R')::INT AS y, l_shipdate < TIMESTAMP '{outcomes.LEARN_BEFORE}' AS learned FROM lineitem),
    base AS (SELECT dataset, avg(y) AS share, stddev_pop(q) AS sq, stddev_pop(p) AS sp,
               avg(q) FILTER (y = 0) AS q0, avg(q) FILTER (y = 1) AS q1, avg(p) FILTER (y = 0) AS p0, avg(p) FILTER (y = 1) AS p1
             FROM lines WHERE learned GROUP BY dataset),
    by_status AS (SELECT dataset, ls, sum(y) AS pos, count(*) AS n FROM lines WHERE learned GROUP BY ALL),
    whole AS (SELECT dataset, sum(pos) AS pos_all, sum(n) AS n_all FROM by_status GROUP BY dataset),
    vote AS (SELECT dataset, {_BALANCED} AS score_vote FROM (SELECT dataset, y, coalesce(pos * n_all > pos_all * n, false) AS guess
             FROM lines JOIN whole USING (dataset) LEFT JOIN by_status USING (dataset, ls) WHERE NOT learned) GROUP BY dataset),
    near AS (SELECT dataset, {_BALANCED} AS score_centroid FROM (SELECT dataset, y,
               coalesce(((q - q1) / nullif(sq, 0)) ** 2 + ((p - p1) / nullif(sp, 0)) ** 2
                 < ((q - q0) / nullif(sq, 0)) ** 2 + ((p - p0) / nullif(sp, 0)) ** 2, false) AS guess
             FROM lines JOIN base USING (dataset) WHERE NOT learned) GROUP BY dataset),
    sup AS (SELECT 'supplier-' || l_suppkey AS dataset, l_quantity AS quantity, l_extendedprice AS price,
              nullif(l_discount, 0) AS discount, nullif(l_tax, 0) AS tax, l_linestatus AS linestatus,
              (l_returnflag = 'R')::INT AS y FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
    described AS ({_exact(_RAW.format(source="sup"))}),
    known AS (SELECT 'supplier-' || s_suppkey AS dataset, 'nation-' || s_nationkey AS family, n_regionkey::VARCHAR AS region
              FROM supplier JOIN nation ON s_nationkey = n_nationkey),
    measured AS (SELECT dataset, family, region, {", ".join(FEATURES)}, score_vote, score_centroid,
                   score_centroid - score_vote AS gap
                 FROM known JOIN described USING (dataset) JOIN vote USING (dataset) JOIN near USING (dataset)
                 WHERE n_classes = 2 AND score_vote IS NOT NULL AND score_centroid IS NOT NULL),
    buy AS (SELECT 'buyer-' || c_nationkey AS dataset, n_regionkey::VARCHAR AS region, l_quantity AS quantity,
              l_extendedprice AS price, nullif(l_discount, 0) AS discount, nullif(l_tax, 0) AS tax,
              l_linestatus AS linestatus, (l_returnflag = 'R')::INT AS y
            FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
              JOIN nation ON c_nationkey = n_nationkey),
    fresh AS ({_exact(_describe("buy", "dataset, region", RET_NUMERIC, RET_CATEGORICAL))})
"""
_WITH = "WITH RECURSIVE" + _CTES

_CHOICE = """CASE WHEN predicted > 0.01 THEN 'centroid' WHEN predicted IS NOT NULL THEN 'vote' END AS recommendation"""


def _ridge_ctes(train: str, told: str, gap: str) -> str:
    """Standardised normal equations per model, solved by Gauss-Jordan steps on lists; ``predicted`` per row of ``told``."""
    p = len(FEATURES)
    stats = ", ".join(
        f"avg({c}) AS m{i}, CASE WHEN stddev_pop({c}) > 1e-12 * greatest(max(abs({c})), 1e-300) THEN stddev_pop({c}) ELSE 1 END AS s{i}"
        for i, c in enumerate(FEATURES)
    )
    z = ", ".join(f"({c} - m{i}) / s{i} AS z{i}" for i, c in enumerate(FEATURES))
    rows = ", ".join(
        "[" + ", ".join(
            [f"sum(z{i} * z{j}){' + 1' if i == j else ''}" for j in range(p)] + [f"sum(z{i} * (y - my))"]
        ) + "]"
        for i in range(p)
    )
    linear = " + ".join(f"w[{i + 1}] * ({c} - m{i}) / s{i}" for i, c in enumerate(FEATURES))
    return f"""train AS ({train}),
    moments AS (SELECT model, count(*) AS n, avg({gap}) AS my, {stats} FROM train GROUP BY model HAVING count(*) >= 2),
    z AS (SELECT model, {gap} AS y, my, {z} FROM train JOIN moments USING (model)),
    equations AS (SELECT model, [{rows}] AS m FROM z GROUP BY model),
    steps AS (SELECT model, 0 AS k, m FROM equations UNION ALL
      SELECT model, k + 1, [[CASE WHEN i = k + 1 THEN m[k + 1][j] / m[k + 1][k + 1]
        ELSE m[i][j] - m[i][k + 1] * m[k + 1][j] / m[k + 1][k + 1] END FOR j IN range(1, {p + 2})] FOR i IN range(1, {p + 1})]
      FROM steps WHERE k < {p}),
    weights AS (SELECT model, [r[{p + 1}] FOR r IN m] AS w FROM steps WHERE k = {p}),
    told AS (SELECT * EXCLUDE (w), my + {linear} AS predicted
             FROM ({told}) LEFT JOIN moments USING (model) LEFT JOIN weights USING (model))"""


def _ridge(key: str) -> str:
    ctes = _ridge_ctes(f"SELECT *, {key} AS model FROM measured", f"SELECT *, {key} AS model FROM fresh", "gap")
    return f"""{_WITH}, {ctes} SELECT dataset, region, {_r("predicted")} AS predicted_gap, {_CHOICE} FROM told"""


def _left_out(source: str) -> str:
    """Every row once for each family that isn't its own."""
    return f"SELECT f.family AS model, r.* FROM (SELECT DISTINCT family FROM {source}) AS f JOIN {source} AS r ON r.family <> f.family"


def _over_meta() -> dict[str, str]:
    """The ridges over the rule benchmark's meta-table."""
    held = _ridge_ctes(_left_out("meta"), "SELECT *, family AS model FROM meta", C.GAP)
    whole = _ridge_ctes("SELECT *, 'all' AS model FROM meta", "SELECT *, 'all' AS model FROM meta", C.GAP)
    return {
        "recommend_ridge_lofo": _evaluation(f"(WITH RECURSIVE {held} SELECT * FROM told)"),
        "in_sample_ridge": f"""SELECT dataset, {_r("predicted")} AS predicted_gap, CASE WHEN predicted > 0.01 THEN 'DNN' ELSE 'GBDT' END
            AS recommendation, 'In-sample fit; judge by held-out families instead.' AS warning
            FROM (WITH RECURSIVE {whole} SELECT * FROM told)""",
    }


SQL: dict[str, str] = {
    "measured_meta": _WITH + f"""SELECT dataset, family, region, {", ".join(_r(c) + f" AS {c}" if c not in ("n_samples", "n_features", "n_classes") else c for c in FEATURES)},
        {_r("score_vote")} AS score_vote, {_r("score_centroid")} AS score_centroid, {_r("gap")} AS {outcomes.GAP} FROM measured""",
    "fitted_models": _WITH + f"""SELECT region AS model, 'ridge' AS kind, CASE WHEN count(*) < 2 THEN 'too_few_rows' ELSE 'ok' END AS status,
        count(*) AS n_rows, CASE WHEN count(*) >= 2 THEN {_r("avg(gap)")} END AS intercept,
        {", ".join(f"CASE WHEN count(*) >= 2 THEN {_r(f'avg({c})')} END AS center_{c}" for c in FEATURES)}
        FROM measured GROUP BY region""",
    "recommend_new_mean": _WITH + f""", told AS (SELECT f.dataset, f.region, predicted FROM fresh AS f LEFT JOIN
        (SELECT region, avg(gap) AS predicted FROM measured GROUP BY region HAVING count(*) >= 2) USING (region))
        SELECT dataset, region, {_r("predicted")} AS predicted_gap, {_CHOICE} FROM told""",
    "recommend_new_ridge": _ridge("'all'"),
    "recommend_new_ridge_by_region": _ridge("region"),
    "held_out_ridge": f"""{_WITH}, {_ridge_ctes(_left_out("measured"), "SELECT *, family AS model FROM measured", "gap")}
        SELECT dataset, family, {_r("gap")} AS {outcomes.GAP}, {_r("predicted")} AS predicted_gap FROM told""",
    **_over_meta(),
}


def statements() -> dict[str, str]:
    return {name: text if text.startswith("WITH") else _query(text) for name, text in SQL.items()}
