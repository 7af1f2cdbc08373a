"""Searches on tables of very different size, many of which fail, with their SQL.

A dataset is one supplier's lines of one quarter. Two small searches run on three folds of each: ``vote`` takes
the more frequent class of a line's level (candidates: status, quantity band, year's month), ``mean`` the class
whose mean is nearer (candidates: quantity, price, discount). A table with a class of fewer rows than folds
isn't searched, a fold whose one-hot matrix would be too large isn't encoded for ``vote``, and a fold without
both classes on either side has no score.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import failures
from ..session import stored
from ..sources.tables import read_table
from .oracle import _r
from .queries import rounded

FOLDS = 3
LIMIT_BYTES = 2600
SIDES = ("vote", "mean")
VOTES = ("linestatus", "band", "month")
MEANS = ("quantity", "price", "discount")
TOO_LARGE = "Dense matrix above the protocol limit."
NO_SCORE = "Estimator produced a non-finite score."
ONE_CLASS = "Every row was given the same class."


def _rows(spark: SparkSession, sf: str) -> DataFrame:
    name = F.concat_ws(
        "-", F.lit("supplier"), "l_suppkey", F.year("l_shipdate"), F.quarter("l_shipdate")
    )
    line = F.concat_ws("|", "l_orderkey", "l_linenumber", "l_partkey", F.round(F.col("l_extendedprice") * 100).cast("bigint"))
    return read_table(spark, sf, "lineitem").select(
        name.alias("dataset"),
        (F.conv(F.substring(F.md5(line), 1, 8), 16, 10).cast("bigint") % FOLDS).cast("int").alias("fold"),
        (F.col("l_returnflag") == "R").cast("int").alias("y"),
        F.col("l_linestatus").alias("linestatus"),
        F.floor(F.col("l_quantity") / 10).cast("string").alias("band"),
        F.month("l_shipdate").cast("string").alias("month"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_extendedprice").alias("price"),
        F.nullif("l_discount", F.lit(0.0)).alias("discount"),
    )


def _scored(told: DataFrame) -> DataFrame:
    """One fit per row from counts (n0, n1) of validation rows with their guess."""
    sums = {
        "hit1": F.sum(F.when(F.col("guess"), F.col("n1")).otherwise(0)), "all1": F.sum("n1"),
        "hit0": F.sum(F.when(~F.col("guess"), F.col("n0")).otherwise(0)), "all0": F.sum("n0"),
        "ones": F.sum(F.when(F.col("guess"), F.col("n0") + F.col("n1")).otherwise(0)),
        "known": F.min(F.col("known").cast("int")),
    }
    per = told.groupBy("dataset", "side", "candidate_order", "fold").agg(*[v.alias(k) for k, v in sums.items()])
    # A fold without a row to score is not run.
    per = per.where("all0 + all1 > 0")
    recall = (F.col("hit1") / F.nullif("all1", F.lit(0)) + F.col("hit0") / F.nullif("all0", F.lit(0))) / 2
    score = F.when(F.col("known") == 1, recall)
    same = (F.col("ones") == 0) | (F.col("ones") == F.col("all0") + F.col("all1"))
    no_warning = F.expr("array()").cast("array<string>")
    return per.select(
        "dataset", "side", "candidate_order", "fold",
        F.when(score.isNotNull(), "success").otherwise("failure").alias("status"),
        # The area under the curve of a yes or no is its mean recall.
        score.alias("balanced_accuracy"), score.alias("roc_auc"), F.lit(None).cast("double").alias("fit_seconds"),
        F.when(same, F.array(F.lit(ONE_CLASS))).otherwise(no_warning).alias("warnings"),
        F.when(score.isNull(), NO_SCORE).alias("error"),
    )


def _votes(rows: DataFrame) -> DataFrame:
    """What a fold's fit sees is all counts minus the fold's."""
    cell = F.explode(F.array(*[F.struct(F.lit(k).alias("candidate_order"), F.col(c).alias("level")) for k, c in enumerate(VOTES)]))
    counts = [F.count_if((F.col("fold") == f) & (F.col("y") == y)).alias(f"n{f}{y}") for f in range(FOLDS) for y in (0, 1)]
    cells = stored(rows.select("dataset", "fold", "y", cell.alias("c")).groupBy("dataset", "c.candidate_order", "c.level").agg(*counts))
    own = lambda f, y: F.col(f"n{f}{y}")
    rest = lambda f, y: sum((own(g, y) for g in range(FOLDS) if g != f), F.lit(0))
    each = F.explode(
        F.array(
            *[
                F.struct(F.lit(f).alias("fold"), own(f, 0).alias("n0"), own(f, 1).alias("n1"), rest(f, 0).alias("fit0"), rest(f, 1).alias("fit1"))
                for f in range(FOLDS)
            ]
        )
    )
    whole = [F.struct(*[F.sum(rest(f, y)).alias(f"whole{y}") for y in (0, 1)]) for f in range(FOLDS)]
    whole = cells.groupBy("dataset", "candidate_order").agg(F.array(*whole).alias("wholes"))
    # Levels meet the totals once and are taken apart by fold afterwards.
    joined = cells.join(whole, ["dataset", "candidate_order"]).select("dataset", "candidate_order", "wholes", each.alias("e"))
    joined = joined.select("dataset", "candidate_order", "e.*", F.get("wholes", "e.fold").alias("all")).select("*", "all.*")
    guess = F.col("fit1") * (F.col("whole0") + F.col("whole1")) > F.col("whole1") * (F.col("fit0") + F.col("fit1"))
    return joined.select("dataset", F.lit("vote").alias("side"), "candidate_order", "fold", "n0", "n1", guess.alias("guess"), ((F.col("whole0") > 0) & (F.col("whole1") > 0)).alias("known"))


def _means(rows: DataFrame) -> DataFrame:
    cell = F.explode(F.array(*[F.struct(F.lit(k).alias("candidate_order"), F.col(c).alias("x")) for k, c in enumerate(MEANS)]))
    present = lambda df, *more: df.select("dataset", "fold", "y", *more, cell.alias("c")).select("dataset", "fold", "y", *more, "c.*").where("x IS NOT NULL")
    sums = [
        e.alias(f"{n}{y}")
        for y in (0, 1)
        for n, e in (("s", F.sum(F.when(F.col("y") == y, F.col("x")).otherwise(0.0))), ("c", F.count_if(F.col("y") == y)))
    ]
    per_fold = stored(present(rows).groupBy("dataset", "candidate_order", "fold").agg(*sums))
    names = ["s0", "c0", "s1", "c1"]
    whole = per_fold.groupBy("dataset", "candidate_order").agg(*[F.sum(c).alias(f"all_{c}") for c in names])
    rest = per_fold.join(whole, ["dataset", "candidate_order"]).select(
        "dataset", "candidate_order", "fold", *[(F.col(f"all_{c}") - F.col(c)).alias(c) for c in names]
    )
    # A row meets the sums of all candidates at once and is taken apart afterwards.
    packed = F.map_from_entries(F.collect_list(F.struct("candidate_order", F.struct(*names).alias("sums")))).alias("known")
    told = present(rows.join(rest.groupBy("dataset", "fold").agg(packed), ["dataset", "fold"]), "known")
    told = told.withColumn("sums", F.try_element_at("known", F.col("candidate_order"))).select("*", "sums.*")
    centre = [F.col(f"s{y}") / F.nullif(F.col(f"c{y}"), F.lit(0)) for y in (0, 1)]
    guess = F.coalesce(F.abs(F.col("x") - centre[1]) + 1e-9 < F.abs(F.col("x") - centre[0]), F.lit(False))
    return told.select(
        "dataset", F.lit("mean").alias("side"), "candidate_order", "fold",
        (1 - F.col("y")).alias("n0"), F.col("y").alias("n1"), guess.alias("guess"),
        ((F.col("c0") > 0) & (F.col("c1") > 0)).alias("known"),
    )


def _encodings(rows: DataFrame) -> DataFrame:
    """Every fold's one-hot width from counted levels; a level counts where another fold has it."""
    cell = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("level")) for c in VOTES]))
    per_fold = [F.count_if(F.col("fold") == f).alias(f"n{f}") for f in range(FOLDS)]
    levels = rows.select("dataset", "fold", cell.alias("c")).groupBy("dataset", "c.column", "c.level").agg(*per_fold)
    other: Callable[[int], Column] = lambda f: sum((F.col(f"n{g}") for g in range(FOLDS) if g != f), F.lit(0))
    widths = levels.groupBy("dataset").agg(*[F.count_if(other(f) > 0).alias(f"w{f}") for f in range(FOLDS)])
    sizes = rows.groupBy("dataset").agg(*per_fold)
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("fold"), (other(f) * F.col(f"w{f}") * 8).alias("size")) for f in range(FOLDS)]))
    sized = sizes.join(widths, "dataset").select("dataset", F.lit("vote").alias("side"), each.alias("e")).select("dataset", "side", "e.*")
    large = F.col("size") > LIMIT_BYTES
    return sized.select(
        "dataset", "side", "fold", F.when(large, "failure").otherwise("success").alias("status"), F.when(large, TOO_LARGE).alias("error")
    )


def _evidence(spark: SparkSession, sf: str) -> DataFrame:
    # Rows of a dataset side by side, so that every count below is nearly complete before its exchange.
    rows = stored(_rows(spark, sf).repartition("dataset"))
    classes = rows.groupBy("dataset").agg(F.count_if(F.col("y") == 1).alias("ones"), F.count_if(F.col("y") == 0).alias("zeros"))
    sides = F.explode(F.array(*[F.lit(s) for s in SIDES])).alias("side")
    searches = classes.select("dataset", F.least("ones", "zeros").alias("class_rows"), sides)
    candidates = searches.select("dataset", "side", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("candidate_order"))
    # Apart, since either side already lies by dataset and candidate or fold.
    fits = _scored(_votes(rows)).unionByName(_scored(_means(rows)))
    return failures.trial_evidence(searches, _encodings(rows), fits, candidates, ["dataset", "side"], FOLDS)


def trial_evidence(spark: SparkSession, sf: str) -> DataFrame:
    found = _evidence(spark, sf)
    return rounded(found.withColumn("convergence_warnings", F.array_join("convergence_warnings", "; ")))


def search_evidence(spark: SparkSession, sf: str) -> DataFrame:
    found = failures.search_evidence(_evidence(spark, sf), ["dataset", "side"])
    return rounded(found.withColumn("convergence_warnings", F.array_join("convergence_warnings", "; ")))


def pair_status(spark: SparkSession, sf: str) -> DataFrame:
    found = failures.search_evidence(_evidence(spark, sf), ["dataset", "side"])
    return rounded(failures.pair_status(found, ["dataset"], SIDES))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (trial_evidence, search_evidence, pair_status)
}

# --- SQL ----------------------------------------------------------------------------------

_VOTE = " UNION ALL ".join(
    f"""SELECT r.dataset, 'vote' AS side, {k} AS candidate_order, r.fold, r.y,
        coalesce(count(*) FILTER (t.y = 1) * any_value(n) > any_value(p) * count(t.y), false) AS guess, any_value(p) > 0 AND any_value(n) > any_value(p) AS known
      FROM (SELECT *, row_number() OVER () AS i FROM lines) AS r JOIN whole USING (dataset, fold)
        LEFT JOIN lines AS t ON t.dataset = r.dataset AND t.fold <> r.fold AND t.{c} = r.{c} GROUP BY r.i, r.dataset, r.fold, r.y"""
    for k, c in enumerate(VOTES)
)
_MEAN = " UNION ALL ".join(
    f"""SELECT r.dataset, 'mean' AS side, {k} AS candidate_order, r.fold, r.y,
        coalesce(abs(any_value(r.{c}) - avg(t.{c}) FILTER (t.y = 1)) + 1e-9 < abs(any_value(r.{c}) - avg(t.{c}) FILTER (t.y = 0)), false) AS guess,
        count(t.{c}) FILTER (t.y = 1) > 0 AND count(t.{c}) FILTER (t.y = 0) > 0 AS known
      FROM (SELECT *, row_number() OVER () AS i FROM lines WHERE {c} IS NOT NULL) AS r
        LEFT JOIN lines AS t ON t.dataset = r.dataset AND t.fold <> r.fold GROUP BY r.i, r.dataset, r.fold, r.y"""
    for k, c in enumerate(MEANS)
)
_WIDTH = " + ".join(f"count(DISTINCT t.{c})" for c in VOTES)
_WITH = f"""WITH lines AS (SELECT concat_ws('-', 'supplier', l_suppkey, year(l_shipdate), quarter(l_shipdate)) AS dataset,
        (('0x' || md5(concat_ws('|', l_orderkey, l_linenumber, l_partkey, round(l_extendedprice * 100)::BIGINT))[1:8])::BIGINT % 3)::INT AS fold,
        (l_returnflag = 'R')::INT AS y, l_linestatus AS linestatus, floor(l_quantity / 10)::BIGINT::VARCHAR AS band,
        month(l_shipdate)::VARCHAR AS month, l_quantity AS quantity, l_extendedprice AS price, nullif(l_discount, 0) AS discount FROM lineitem),
    names AS (SELECT DISTINCT dataset FROM lines),
    folds AS (SELECT dataset, f::INT AS fold FROM names, range(3) AS r(f)),
    whole AS (SELECT f.dataset, f.fold, count(y) AS n, coalesce(sum(y), 0) AS p FROM folds AS f
              LEFT JOIN lines AS t ON t.dataset = f.dataset AND t.fold <> f.fold GROUP BY ALL),
    told AS ({_VOTE} UNION ALL {_MEAN}),
    fits AS (SELECT dataset, side, candidate_order, fold,
        CASE WHEN bool_and(known) THEN (count(*) FILTER (y = 1 AND guess) / nullif(count(*) FILTER (y = 1), 0)::DOUBLE
          + count(*) FILTER (y = 0 AND NOT guess) / nullif(count(*) FILTER (y = 0), 0)::DOUBLE) / 2 END AS score,
        count(DISTINCT guess) = 1 AS same FROM told GROUP BY ALL),
    bad_fold AS (SELECT f.dataset, 'vote' AS side, min(f.fold) AS stop FROM (
        SELECT f.dataset, f.fold, count(t.y) * ({_WIDTH}) * 8 AS size FROM folds AS f JOIN lines AS t
          ON t.dataset = f.dataset AND t.fold <> f.fold GROUP BY ALL) AS f WHERE size > {LIMIT_BYTES} GROUP BY ALL),
    small AS (SELECT dataset, least(count(*) FILTER (y = 1), count(*) FILTER (y = 0)) AS c FROM lines GROUP BY dataset),
    ran AS (SELECT f.*, coalesce(stop, 99) AS stop, min(CASE WHEN score IS NULL THEN fold END)
              OVER (PARTITION BY f.dataset, f.side, candidate_order) AS failed
            FROM fits AS f JOIN small USING (dataset) LEFT JOIN bad_fold USING (dataset, side) WHERE c >= 3 AND fold < coalesce(stop, 99)),
    kept AS (SELECT * FROM ran WHERE failed IS NULL OR fold <= failed),
    tried AS (SELECT dataset, side, candidate_order, count(score) AS done, max(failed) AS failed, sum(score ORDER BY fold) / 3 AS mean,
              bool_or(same) AS same FROM kept GROUP BY ALL),
    trials AS (SELECT n.dataset, n.side, n.candidate_order,
        CASE WHEN c < 3 THEN 'Smallest training class has ' || c || ' rows; every inner fold needs one.'
          WHEN t.failed IS NOT NULL THEN '{NO_SCORE}' WHEN stop IS NOT NULL THEN '{TOO_LARGE}'
          WHEN coalesce(done, 0) < 3 THEN '{failures.INCOMPLETE}' END AS error,
        CASE WHEN c >= 3 THEN coalesce(t.failed, stop) END AS first_failed_fold, coalesce(done, 0)::INT AS completed_folds,
        coalesce(same, false) AS same, mean
      FROM (SELECT dataset, side, k::INT AS candidate_order FROM names, (VALUES ('vote'), ('mean')) AS s(side), range(3) AS r(k)) AS n
        JOIN small USING (dataset) LEFT JOIN tried AS t USING (dataset, side, candidate_order) LEFT JOIN bad_fold USING (dataset, side)),
    searches AS (SELECT dataset, side, count(*) AS n_trials, count(error) AS failed_trials, count(error) = 0 AS ok,
        min(struct_pack(a := coalesce(first_failed_fold, -1), b := candidate_order, c := error)) FILTER (error IS NOT NULL) AS first,
        bool_or(same) AS same, max(struct_pack(s := mean, o := -candidate_order)) AS best FROM trials GROUP BY ALL)"""

SQL: dict[str, str] = {
    "trial_evidence": _WITH + f""" SELECT dataset, side, candidate_order, CASE WHEN error IS NULL THEN 'success' ELSE 'failure' END AS status,
        error, first_failed_fold, completed_folds, 0.0::DOUBLE AS fit_seconds, CASE WHEN same THEN '{ONE_CLASS}' ELSE '' END AS convergence_warnings,
        CASE WHEN error IS NULL THEN {_r("mean")} END AS mean_balanced_accuracy, CASE WHEN error IS NULL THEN {_r("mean")} END AS mean_roc_auc FROM trials""",
    "search_evidence": _WITH + f""" SELECT dataset, side, n_trials, failed_trials, ok AS all_trials_completed,
        CASE WHEN NOT ok THEN '{failures.NO_WINNER}' END AS error, first.c AS first_error, 0.0::DOUBLE AS search_seconds,
        CASE WHEN same THEN '{ONE_CLASS}' ELSE '' END AS convergence_warnings, CASE WHEN ok THEN (-best.o)::INT END AS selected_candidate_order,
        CASE WHEN ok THEN {_r("best.s")} END AS inner_balanced_accuracy FROM searches""",
    "pair_status": _WITH + f""" SELECT dataset, v.ok AND m.ok AS paired_success, CASE WHEN v.ok AND m.ok THEN {_r("m.best.s - v.best.s")} END AS gap,
        CASE WHEN NOT v.ok THEN 'vote: ' || v.first.c WHEN NOT m.ok THEN 'mean: ' || m.first.c END AS reason
        FROM (SELECT * FROM searches WHERE side = 'vote') AS v JOIN (SELECT * FROM searches WHERE side = 'mean') AS m USING (dataset)""",
}


def statements() -> dict[str, str]:
    return dict(SQL)
