"""The registered queries as ANSI SQL over the same tables, written independently of Spark.

``CTES`` are shared building blocks; ``_query`` puts the needed ones in front of a statement.
"""

from __future__ import annotations

import json
import re

from .. import constants as C
from ..protocol import FULL, SMOKE, Protocol, candidates
from .queries import CUTOFF, TABLES
from .rules import resolution


def _r(expression: str) -> str:
    """Same rounding as ``queries.rounded``."""
    return f"round({expression} + 1e-10, 6) + 0.0"


def _values(rows: list[tuple]) -> str:
    def cell(v) -> str:
        return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)

    return ", ".join("(" + ", ".join(cell(v) for v in row) + ")" for row in rows)


def _candidate_rows(p: Protocol) -> list[tuple]:
    rows = []
    for family in C.FAMILIES:
        for order, params in enumerate(candidates(family, p.candidate_count, p.tuning_seed)):
            plain = {k: list(v) if isinstance(v, tuple) else v for k, v in params.items()}
            rows.append(
                (
                    family,
                    C.MODEL_OF_FAMILY[family],
                    order,
                    resolution(family, params),
                    json.dumps(plain, separators=(",", ":")),
                )
            )
    return rows


def _describe(source: str, keys: str, numeric: list[str], categorical: list[str]) -> str:
    """Descriptor SQL with one real distinct count per column, unlike the Spark version."""
    columns = numeric + categorical
    p = len(columns)
    missing = " + ".join(f"sum(({c} IS NULL)::INT)" for c in columns)
    any_missing = " OR ".join(f"{c} IS NULL" for c in columns)
    constant = " + ".join(
        f"((count(DISTINCT {c}) + (count(*) > count({c}))::INT) <= 1)::INT" for c in columns
    )
    fraction = 1 - len(numeric) / p
    return f"""
        SELECT {keys}, 'ok' AS status, count(*) AS n_samples, {p}::BIGINT AS n_features,
          count(DISTINCT y) AS n_classes, {_r(f"count(*) / {p}.0::DOUBLE")} AS samples_per_feature,
          {_r(f"{fraction}::DOUBLE")} AS categorical_fraction,
          {_r(f"({missing}) / (count(*) * {p})::DOUBLE")} AS missing_fraction,
          {_r(f"sum(({any_missing})::INT) / count(*)::DOUBLE")} AS rows_with_missing_fraction,
          {_r(f"({constant}) / {p}::DOUBLE")} AS constant_feature_fraction,
          {_r("least(sum(y), sum(1 - y)) / count(*)::DOUBLE")} AS minority_class_fraction,
          {_r("greatest(sum(y), sum(1 - y)) / least(sum(y), sum(1 - y))::DOUBLE")}
            AS imbalance_ratio
        FROM {source} GROUP BY {keys}"""


def _splits(prefix: str, source: str, seeds: tuple[int, ...], k: int) -> dict[str, str]:
    """Ranked rows of a source with their part and fold."""
    firsts = [f"(({f} - train_before) % {k} + {k}) % {k}" for f in range(k)]
    sizes = [f"greatest(0, (class_train - {first} + {k - 1}) // {k})" for first in firsts]
    ends = []
    for f in range(k - 1):
        ends.append(" + ".join(sizes[: f + 1]))
    folds = " ".join(f"WHEN rnk - class_test <= {end} THEN {f}" for f, end in enumerate(ends))
    seed_rows = ", ".join(f"({s})" for s in seeds)
    return {
        f"{prefix}_classes": f"SELECT dataset, y, count(*) AS n FROM {source} GROUP BY ALL",
        f"{prefix}_shares": f"""
            SELECT dataset, y, n, t, (t * n) // total AS base, (t * n) % total AS rest
            FROM {prefix}_classes JOIN (
              SELECT dataset, sum(n)::BIGINT AS total, ceil(sum(n) * 0.25)::BIGINT AS t
              FROM {prefix}_classes GROUP BY dataset) USING (dataset)""",
        f"{prefix}_quota": f"""
            SELECT dataset, y, n, class_test, n - class_test AS class_train,
              coalesce(sum(n - class_test) OVER (PARTITION BY dataset ORDER BY y
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS train_before
            FROM (SELECT *, base + (row_number() OVER (PARTITION BY dataset
                    ORDER BY rest DESC, y) <= left_over)::INT AS class_test
                  FROM (SELECT *, t - sum(base) OVER (PARTITION BY dataset) AS left_over
                        FROM {prefix}_shares))""",
        f"{prefix}_split": f"""
            SELECT *, CASE WHEN rnk <= class_test THEN 'test' ELSE 'train' END AS part,
              (CASE WHEN rnk <= class_test THEN NULL {folds} ELSE {k - 1} END)::INT AS fold
            FROM (SELECT s.*, seed AS outer_seed, class_test, class_train, train_before,
                    row_number() OVER (PARTITION BY dataset, y, seed
                      ORDER BY md5(seed || '|' || row_id)) AS rnk
                  FROM {source} s JOIN {prefix}_quota USING (dataset, y),
                    (VALUES {seed_rows}) v(seed))""",
    }


def _mean(column: str, k: int) -> str:
    """Left-to-right mean over stages 0..k-1 of a pivoted group."""
    terms = " + ".join(f"max({column}) FILTER (stage = {s})" for s in range(k))
    return f"(({terms}) / {k}.0::DOUBLE)"


def _bench(prefix: str, p: Protocol) -> dict[str, str]:
    """Rule scores, trials, winners, pairs and outcomes of a protocol."""
    k = p.inner_folds
    stages = ", ".join(f"({s})" for s in range(k + 1))
    rules = _values([(f, c) for f, cs in (("GBDT", (4, 8, 16)), ("DNN", (8, 16, 32))) for c in cs])
    group = "dataset, outer_seed, family, cells, stage"
    hashed = ", ".join(
        f"coalesce({c}::VARCHAR, '{C.MISSING_LEVEL}')" for c in ("linestatus", "discount", "tax")
    )
    n_seeds = len(p.outer_seeds)

    def over_seeds(column: str) -> str:
        terms = " + ".join(f"max({column}) FILTER (outer_seed = {s})" for s in p.outer_seeds)
        return f"(({terms}) / {n_seeds}.0::DOUBLE)"

    return {
        **_splits(prefix, "ret", p.outer_seeds, k),
        f"{prefix}_cells": f"""
            SELECT dataset, outer_seed, coalesce(fold, {k}) AS part_no, y,
              coalesce(greatest(least(floor((quantity - 0.0) / 50.0 * 16), 15), 0), -1)::INT AS band,
              (('0x' || substr(md5(concat_ws('|', {hashed})), 1, 6))::BIGINT % 32)::INT AS bucket
            FROM {prefix}_split""",
        f"{prefix}_counts": f"""
            SELECT dataset, outer_seed, part_no, family, cells,
              CASE WHEN family = 'GBDT' THEN
                CASE WHEN band < 0 THEN -1 ELSE band // (16 // cells) END
              ELSE bucket % cells END AS cell,
              count(*) AS n, sum(y) AS p
            FROM {prefix}_cells, (VALUES {rules}) r(family, cells) GROUP BY ALL""",
        f"{prefix}_stages": f"""
            SELECT {group}, cell,
              coalesce(sum(n) FILTER (part_no < {k} AND part_no <> stage), 0)::DOUBLE AS n_fit,
              coalesce(sum(p) FILTER (part_no < {k} AND part_no <> stage), 0)::DOUBLE AS p_fit,
              coalesce(sum(n - p) FILTER (part_no = stage), 0)::DOUBLE AS neg,
              coalesce(sum(p) FILTER (part_no = stage), 0)::DOUBLE AS pos
            FROM {prefix}_counts, (VALUES {stages}) v(stage) GROUP BY ALL""",
        f"{prefix}_scored": f"""
            SELECT *, CASE WHEN n_fit > 0 THEN p_fit / n_fit ELSE prior END AS score
            FROM (SELECT *, sum(p_fit) OVER g / sum(n_fit) OVER g AS prior
                  FROM {prefix}_stages WINDOW g AS (PARTITION BY {group}))""",
        f"{prefix}_ties": f"""
            SELECT {group}, score, bool_or(score > prior) AS hit, sum(neg) AS neg, sum(pos) AS pos
            FROM {prefix}_scored GROUP BY {group}, score""",
        f"{prefix}_scores": f"""
            SELECT {group},
              (sum(neg) FILTER (NOT hit) / sum(neg)) AS r0, (sum(pos) FILTER (hit) / sum(pos)) AS r1,
              (coalesce(sum(neg) FILTER (NOT hit), 0) / sum(neg)
                + coalesce(sum(pos) FILTER (hit), 0) / sum(pos)) / 2 AS balanced_accuracy,
              sum(neg * (coalesce(above, 0) + pos / 2)) / (sum(neg) * sum(pos)) AS roc_auc
            FROM (SELECT *, sum(pos) OVER (PARTITION BY {group} ORDER BY score DESC
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS above
                  FROM {prefix}_ties) GROUP BY {group}""",
        f"{prefix}_candidates": f"""
            SELECT * FROM (VALUES {_values(_candidate_rows(p))})
              c(family, model, candidate_order, cells, params_json)""",
        f"{prefix}_trials": f"""
            SELECT dataset, outer_seed, family, candidate_order, cells,
              {_mean("balanced_accuracy", k)} AS mean_ba, {_mean("roc_auc", k)} AS mean_auc,
              max(balanced_accuracy) FILTER (stage = {k}) AS outer_ba,
              max(roc_auc) FILTER (stage = {k}) AS outer_auc
            FROM {prefix}_scores JOIN {prefix}_candidates USING (family, cells)
            GROUP BY dataset, outer_seed, family, candidate_order, cells""",
        f"{prefix}_ranked": f"""
            SELECT *, row_number() OVER (PARTITION BY dataset, outer_seed, family
              ORDER BY mean_ba DESC, candidate_order) AS candidate_rank FROM {prefix}_trials""",
        f"{prefix}_winners": f"SELECT * FROM {prefix}_ranked WHERE candidate_rank = 1",
        f"{prefix}_pairs": f"""
            SELECT dataset, outer_seed, g.outer_ba AS ba_g, d.outer_ba AS ba_d,
              g.outer_auc AS auc_g, d.outer_auc AS auc_d
            FROM (SELECT * FROM {prefix}_winners WHERE family = 'GBDT') g
            JOIN (SELECT * FROM {prefix}_winners WHERE family = 'DNN') d
              USING (dataset, outer_seed)""",
        f"{prefix}_outcome": f"""
            SELECT dataset, s_g AS {C.SCORE_GBDT}, s_d AS {C.SCORE_DNN}, s_d - s_g AS {C.GAP},
              CASE WHEN s_d - s_g > 0 THEN 'DNN' ELSE 'GBDT' END AS actual_best_pipeline,
              abs(s_d - s_g) <= {p.recommendation_margin} AS near_tie_within_margin
            FROM (SELECT dataset, {over_seeds("ba_g")} AS s_g, {over_seeds("ba_d")} AS s_d
                  FROM {prefix}_pairs GROUP BY dataset)""",
    }


RET_NUMERIC = ["quantity", "price", "discount", "tax"]
RET_CATEGORICAL = ["linestatus"]

CTES: dict[str, str] = {
    "ret": """
        SELECT 'supplier-' || l_suppkey AS dataset, 'nation-' || s_nationkey AS family,
          concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey,
            round(l_extendedprice * 100)::BIGINT) AS row_id,
          l_quantity AS quantity, l_extendedprice AS price, nullif(l_discount, 0) AS discount,
          nullif(l_tax, 0) AS tax, l_linestatus AS linestatus, l_returnflag AS label,
          (l_returnflag = 'R')::INT AS y
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey""",
    "people": """
        SELECT 'supplier-' || s_suppkey AS dataset, s_suppkey AS k,
          (s_suppkey + 1)::BIGINT AS openml_id, 1::BIGINT AS version,
          'nation-' || s_nationkey AS family, s_nationkey % 5 = 0 AS clinical
        FROM supplier""",
    "doc_quality": """
        SELECT 'doc_quality' AS dataset, doc_id::VARCHAR AS row_id, n_chars::DOUBLE AS n_chars,
          lang, source, quality::INT AS y FROM documents JOIN labels USING (doc_id)""",
    "doc_toxic": """
        SELECT 'doc_toxic' AS dataset, doc_id::VARCHAR AS row_id, n_chars::DOUBLE AS n_chars,
          lang, source, toxic::INT AS y FROM documents JOIN labels USING (doc_id)""",
    "ord_urgent": """
        SELECT 'order_urgent' AS dataset, o_totalprice AS totalprice, o_orderstatus AS orderstatus,
          (o_orderpriority = '1-URGENT')::INT AS y FROM orders""",
    "ev_purchase": """
        SELECT 'event_purchase' AS dataset, value, hour(ts)::VARCHAR AS hour,
          (event_type = 'purchase')::INT AS y FROM events""",
    "cu_building": """
        SELECT 'cust_building' AS dataset, c_acctbal AS acctbal, c_nationkey::VARCHAR AS nation,
          (c_mktsegment = 'BUILDING')::INT AS y FROM customer""",
    "signatures": """
        SELECT dataset, quantity, discount, tax, count(*) AS n, count(*) FILTER (y = 0) AS n0,
          count(*) FILTER (y = 1) AS n1 FROM ret GROUP BY dataset, quantity, discount, tax""",
    "shaped": f"""
        SELECT o_custkey % 7 AS id, o_orderstatus AS status, o_orderpriority AS priority,
          floor(o_totalprice / 100)::BIGINT AS price_band, nullif(month(o_orderdate), 1) AS month,
          o_orderdate < TIMESTAMP '{CUTOFF}' AS early FROM orders""",
    "medians": """
        SELECT dataset, cname, count(*) AS n_rows, count(*) - count(v) AS n_missing,
          coalesce(median(v), 0) AS med FROM long_ret GROUP BY dataset, cname""",
    "long_ret": """
        SELECT dataset, 'quantity' AS cname, quantity AS v FROM ret
        UNION ALL SELECT dataset, 'price', price FROM ret
        UNION ALL SELECT dataset, 'discount', discount FROM ret
        UNION ALL SELECT dataset, 'tax', tax FROM ret""",
    "ret_width": """
        SELECT dataset, count(*) AS n_rows,
          4 + (count(*) > count(quantity))::INT + (count(*) > count(price))::INT
            + (count(*) > count(discount))::INT + (count(*) > count(tax))::INT
            + count(DISTINCT coalesce(linestatus, '__missing__')) AS width
        FROM ret GROUP BY dataset""",
    **_bench("full", FULL),
    **_bench("smoke", SMOKE),
    "meta_descriptors": f"""
        SELECT dataset, {", ".join(f"avg({d}) AS {d}" for d in C.DESCRIPTORS)}
        FROM raw_descriptors GROUP BY dataset""",
    "raw_descriptors": re.sub(
        r"round\((.*) \+ 1e-10, 6\) \+ 0\.0",
        r"\1",
        _describe("full_train", "dataset, outer_seed", RET_NUMERIC, RET_CATEGORICAL),
    ),
    "full_train": "SELECT * FROM full_split WHERE part = 'train'",
    "meta": f"""
        SELECT dataset, openml_id, version, family, clinical,
          {", ".join(C.DESCRIPTORS)}, {C.SCORE_GBDT}, {C.SCORE_DNN}, {C.GAP},
          actual_best_pipeline, near_tie_within_margin
        FROM people JOIN meta_descriptors USING (dataset) JOIN full_outcome USING (dataset)""",
    "fixed": f"""
        SELECT f.family, CASE WHEN avg({C.SCORE_DNN}) > avg({C.SCORE_GBDT})
            THEN 'DNN' ELSE 'GBDT' END AS best_fixed, avg({C.GAP}) AS mean_gap, count(*) AS n
        FROM (SELECT DISTINCT family FROM meta) f JOIN meta m ON m.family <> f.family
        GROUP BY f.family""",
    "dummy_predicted": "SELECT m.*, mean_gap AS predicted FROM meta m JOIN fixed USING (family)",
    "ridge1_predicted": f"""
        SELECT m.*, mean_y + (m.missing_fraction - mean_x) / sd * slope AS predicted
        FROM meta m JOIN (
          SELECT family, mean_x, mean_y, sd, sxy / sd / (CASE WHEN flat THEN 0 ELSE n END + 1.0)
              AS slope
          FROM (SELECT f.family, count(*) AS n, avg(x) AS mean_x, avg(y) AS mean_y,
                  stddev_pop(x) <= 1e-12 AS flat,
                  CASE WHEN stddev_pop(x) <= 1e-12 THEN 1.0 ELSE stddev_pop(x) END AS sd,
                  CASE WHEN stddev_pop(x) <= 1e-12 THEN 0.0 ELSE covar_pop(x, y) * count(*) END
                    AS sxy
                FROM (SELECT DISTINCT family FROM meta) f
                JOIN (SELECT family AS other, missing_fraction AS x, {C.GAP} AS y FROM meta) t
                  ON t.other <> f.family GROUP BY f.family)) USING (family)""",
    "runs": """
        SELECT dataset, k % 12 AS kind, k // 12 AS block, dataset || '.full.json' AS path,
          CASE WHEN k % 12 IN (6, 7) THEN 'shared-' || (k // 12) ELSE dataset END AS claim_name,
          CASE WHEN k % 12 = 8 THEN openml_id + 1 ELSE openml_id END AS claim_id
        FROM people JOIN full_outcome USING (dataset)""",
    "claims": """
        SELECT 'name' AS kind, claim_name AS value, path FROM runs WHERE kind NOT IN (4, 5, 10, 11)
        UNION ALL SELECT 'openml_id', claim_id::VARCHAR, path FROM runs
          WHERE kind NOT IN (4, 5, 10, 11)""",
    "clashes": """
        SELECT kind, value, count(*) AS claimants
        FROM claims GROUP BY kind, value HAVING count(*) > 1""",
    "judged": """
        SELECT r.*, c.shared,
          CASE kind WHEN 3 THEN 'invalid_result' WHEN 4 THEN 'malformed_json'
            WHEN 5 THEN 'malformed_json' WHEN 8 THEN 'invalid_result' WHEN 10 THEN 'invalid_result'
            WHEN 11 THEN 'unreadable_input' ELSE 'accepted' END AS own_code,
          CASE kind WHEN 3 THEN 'status: unexpected_value' WHEN 4 THEN 'Malformed JSON'
            WHEN 5 THEN 'Malformed JSON'
            WHEN 8 THEN 'outer_splits[0].meta_features.n_classes: inconsistent'
            WHEN 10 THEN 'project: unexpected_value' WHEN 11 THEN 'Unreadable input'
            ELSE 'All full evidence holds' END AS own_reason
        FROM runs r LEFT JOIN (SELECT path, string_agg(kind || '=' || value || ' (' || claimants
            || ' claims)', ', ' ORDER BY kind, value) AS shared
          FROM claims JOIN clashes USING (kind, value) GROUP BY path) c USING (path)""",
    "ledger": """
        SELECT path, dataset,
          CASE WHEN shared IS NULL AND own_code = 'accepted' THEN 'accepted' ELSE 'rejected' END
            AS outcome,
          CASE WHEN shared IS NOT NULL THEN 'duplicate_identity' ELSE own_code END AS code,
          CASE WHEN shared IS NOT NULL
            THEN 'identity claimed more than once: ' || shared
            ELSE own_reason END AS reason,
          CASE WHEN shared IS NOT NULL AND own_code <> 'accepted' THEN own_reason END
            AS validation_reason
        FROM judged""",
    "entries": """
        SELECT dataset, k, k % 13 AS kind, family,
          CASE WHEN k % 13 = 6 THEN openml_id - 1 ELSE openml_id END AS openml_id
        FROM people""",
    "twice": "SELECT openml_id FROM entries GROUP BY openml_id HAVING count(*) > 1",
}


def _query(statement: str) -> str:
    """The statement behind the CTEs it needs, dependencies first."""
    ordered: list[str] = []

    def need(text: str) -> None:
        names = re.sub(r"'[^']*'", "", text)
        for name in CTES:
            if name not in ordered and re.search(rf"\b(FROM|JOIN|,)\s+{name}\b", names):
                need(CTES[name])
                if name not in ordered:
                    ordered.append(name)

    need(statement)
    if not ordered:
        return statement.strip()
    blocks = ",\n".join(f"{name} AS ({CTES[name].strip()})" for name in ordered)
    return f"WITH {blocks}\n{statement.strip()}"


def _evaluation(source: str) -> str:
    g, d = C.SCORE_GBDT, C.SCORE_DNN
    return f"""
        SELECT dataset, family, {_r(C.GAP)} AS actual_gap, {_r("predicted")} AS predicted_gap, rec
            AS recommendation, actual_best_pipeline, rec = actual_best_pipeline
            AS correct_best_pipeline,
          {_r(f"greatest({g}, {d}) - CASE rec WHEN 'DNN' THEN {d} ELSE {g} END")} AS regret,
          {_r(f"greatest({g}, {d}) - {g}")} AS regret_always_gbdt,
          {_r(f"greatest({g}, {d}) - {d}")} AS regret_always_dnn,
          best_fixed AS best_fixed_from_training,
          {_r(f"greatest({g}, {d}) - CASE best_fixed WHEN 'DNN' THEN {d} ELSE {g} END")}
            AS regret_best_fixed,
          0.0::DOUBLE AS regret_oracle
        FROM (SELECT *, CASE WHEN predicted > 0.01 THEN 'DNN' ELSE 'GBDT' END AS rec
              FROM {source}) JOIN (SELECT family, best_fixed FROM fixed) USING (family)"""


def _roles() -> str:
    parts = []
    for table in TABLES:
        parts.append(
            f"""
        SELECT '{table}' AS dataset, d.position, d.column_name AS "column",
          CASE WHEN column_type IN ('BIGINT', 'INTEGER', 'DOUBLE', 'FLOAT') THEN 'numeric'
            WHEN column_type IN ('VARCHAR', 'BOOLEAN') THEN 'categorical'
            ELSE 'unsupported' END AS role, u.present
        FROM (SELECT column_name, column_type, (row_number() OVER () - 1)::INT AS position
              FROM (DESCRIBE {table})) d
        JOIN (SELECT cname, present::BIGINT AS present
              FROM (UNPIVOT (SELECT count(COLUMNS(*)) FROM {table}) ON COLUMNS(*)
                INTO NAME cname VALUE present)) u ON u.cname = d.column_name"""
        )
    return "\nUNION ALL\n".join(parts)


def _describe_tables() -> str:
    specs = (
        ("doc_quality", ["n_chars"], ["lang", "source"]),
        ("doc_toxic", ["n_chars"], ["lang", "source"]),
        ("ord_urgent", ["totalprice"], ["orderstatus"]),
        ("ev_purchase", ["value"], ["hour"]),
        ("cu_building", ["acctbal"], ["nation"]),
    )
    return "\nUNION ALL\n".join(
        _describe(name, "dataset", numeric, categorical) for name, numeric, categorical in specs
    )


def _fold_width(stage: int, k: int) -> str:
    inside = f"part = 'train' AND fold <> {stage}" if stage < k else "part = 'train'"
    gaps = " + ".join(
        f"(count(*) FILTER ({inside} AND {c} IS NULL) > 0)::INT" for c in RET_NUMERIC
    )
    return f"""
        SELECT dataset, outer_seed, {stage}::INT AS stage, (4 + {gaps}
          + count(DISTINCT linestatus) FILTER ({inside}))::BIGINT AS width
        FROM full_split GROUP BY dataset, outer_seed"""


def _missing(source: str, columns: list[str], keys: str) -> str:
    return "\nUNION ALL\n".join(
        f"SELECT {keys}, {i}::INT AS position, '{c}' AS \"column\", "
        f"(count(*) - count({c}))::BIGINT AS missing FROM {source} GROUP BY {keys} "
        f"HAVING count(*) > count({c})"
        for i, c in enumerate(columns)
    )


def _constants() -> str:
    columns = [*RET_NUMERIC, "flat", "hollow", "gappy", "linestatus", "home"]
    parts = []
    for i, c in enumerate(columns):
        parts.append(
            f"SELECT dataset, {i}::INT AS position, '{c}' AS \"column\" FROM wide GROUP BY dataset "
            f"HAVING count(DISTINCT {c}) + (count(*) > count({c}))::INT <= 1"
        )
    wide = """
        SELECT *, 7.0 AS flat, NULL::DOUBLE AS hollow,
          CASE WHEN discount IS NOT NULL THEN 1.0 END AS gappy, family AS home FROM ret"""
    return f"SELECT * FROM (WITH wide AS ({wide}) " + " UNION ALL ".join(parts) + ")"


def _audit(source: str) -> str:
    return f"""
        SELECT dataset, sum(n)::BIGINT AS n_rows,
          coalesce(sum(n) FILTER (n > 1), 0)::BIGINT AS duplicate_feature_rows,
          count(*) FILTER (n > 1) AS duplicate_feature_groups,
          (coalesce(sum(n0) FILTER (n0 > 1), 0) + coalesce(sum(n1) FILTER (n1 > 1), 0))::BIGINT
            AS exact_duplicate_rows,
          count(*) FILTER (n0 > 1) + count(*) FILTER (n1 > 1) AS exact_duplicate_groups,
          coalesce(sum(n) FILTER (n0 > 0 AND n1 > 0), 0)::BIGINT
            AS conflicting_target_signature_rows,
          count(*) FILTER (n0 > 0 AND n1 > 0) AS conflicting_target_signature_groups
        FROM {source} GROUP BY dataset"""


def _overlap(scope: str, columns: str) -> str:
    return f"""
        SELECT '{scope}' AS scope, count(*) FILTER (a > 0 AND b > 0) AS shared_signatures,
          coalesce(sum(a) FILTER (a > 1), 0)::BIGINT AS left_repeated_rows,
          coalesce(sum(b) FILTER (b > 1), 0)::BIGINT AS right_repeated_rows
        FROM (SELECT {columns}, count(*) FILTER (early) AS a, count(*) FILTER (NOT early) AS b
              FROM shaped GROUP BY {columns})"""


CTES["dq_levels"] = f"""
        SELECT cname, level, row_number() OVER (ORDER BY cpos, level) - 1 AS at_position FROM (
          SELECT DISTINCT 0 AS cpos, 'lang' AS cname, coalesce(lang, '{C.MISSING_LEVEL}') AS level
          FROM dq_split WHERE part = 'train'
          UNION SELECT DISTINCT 1, 'source', coalesce(source, '{C.MISSING_LEVEL}')
          FROM dq_split WHERE part = 'train')"""
CTES["dq_median"] = """
        SELECT median(n_chars) AS m, avg((n_chars IS NULL)::INT) AS gap
        FROM dq_split WHERE part = 'train'"""
CTES["dq_stats"] = """
        SELECT m, gap, avg(coalesce(n_chars, m)) AS mu, stddev_pop(coalesce(n_chars, m)) AS sd
        FROM dq_split CROSS JOIN dq_median WHERE part = 'train' GROUP BY m, gap"""


def _design() -> str:
    """Encoded rows of the quality task in long form, statistics from training rows."""
    return f"""
        SELECT 'doc_quality' AS dataset, row_id, 0::INT AS position, 'n_chars' AS name,
          {_r("(coalesce(n_chars, m) - mu) / sd")} AS value FROM dq_split, dq_stats
        UNION ALL
        SELECT 'doc_quality', row_id, 1, 'missingindicator_n_chars',
          {_r("((n_chars IS NULL)::INT - gap) / sqrt(gap * (1 - gap))")} FROM dq_split, dq_stats
          WHERE gap > 0
        UNION ALL
        SELECT 'doc_quality', row_id, (1 + (gap > 0)::INT + at_position)::INT,
          cname || '_' || level,
          (level = CASE cname WHEN 'lang' THEN lang ELSE source END)::INT::DOUBLE
        FROM dq_split, dq_levels, dq_stats"""


CTES["dq"] = """
        SELECT dataset, row_id, nullif(n_chars % 50, 0) AS n_chars, lang, source, y
        FROM doc_quality"""
CTES.update(_splits("dq", "dq", (42,), 3))


def statements() -> dict[str, str]:
    meta_columns = ", ".join(
        [_r(f"{c}") + f" AS {c}" for c in (*C.DESCRIPTORS, C.SCORE_GBDT, C.SCORE_DNN, C.GAP)]
    )
    p, k = FULL, FULL.inner_folds
    raw = {
        "load_summary": """
            SELECT dataset, count(*) AS n_rows, 5::BIGINT AS n_features,
              (count(*) * 5 - count(quantity) - count(price) - count(discount) - count(tax)
                - count(linestatus))::BIGINT AS missing_cells,
              count(*) FILTER (label <> 'R') AS rows_other, count(*) FILTER (label = 'R') AS rows_r,
              0::INT AS code_other, 1::INT AS code_r
            FROM ret GROUP BY dataset""",
        "contract_checks": """
            SELECT dataset AS name,
              CASE WHEN openml_id IN (SELECT openml_id FROM twice) THEN 'duplicate_entry'
                WHEN kind IN (1, 2) THEN 'class_labels' WHEN kind = 3 THEN 'no_predictors'
                WHEN kind = 4 THEN 'roles_overlap' WHEN kind = 7 THEN 'skipped'
                WHEN kind = 8 THEN 'identity_mismatch'
                WHEN kind = 9 OR n IS NULL THEN 'row_count'
                WHEN kind = 10 THEN 'columns' WHEN kind = 11 THEN 'numeric_types'
                WHEN n1 = 0 OR n0 = 0 OR kind = 12 THEN 'classes' ELSE 'ok' END AS status
            FROM entries LEFT JOIN (SELECT dataset, count(*) AS n, count(*) FILTER (y = 1) AS n1,
              count(*) FILTER (y = 0) AS n0 FROM ret GROUP BY dataset) USING (dataset)""",
        "registry_listing": """
            SELECT dataset AS name, openml_id, 1::BIGINT AS version, family, false AS clinical,
              (coalesce(n, 0) + (kind = 9)::INT)::BIGINT AS expected_rows,
              CASE WHEN kind = 3 THEN 0 WHEN kind = 10 THEN 6 ELSE 5 END::INT AS n_features
            FROM entries LEFT JOIN (SELECT dataset, count(*) AS n FROM ret GROUP BY dataset)
              USING (dataset) WHERE kind <> 7""",
        "requested_names": """
            SELECT 'supplier-' || (k * 2) AS name,
              CASE WHEN k * 2 > (SELECT max(k) FROM people) THEN 'unknown'
                WHEN (k * 2) % 13 = 7 THEN 'clinical' ELSE 'known' END AS request FROM people""",
        "characterize_single": _describe("doc_quality", "dataset", ["n_chars"], ["lang", "source"]),
        "characterize_tables": _describe_tables(),
        "characterize_grouped": _describe("ret", "dataset", RET_NUMERIC, RET_CATEGORICAL),
        "characterize_train_parts": _describe(
            "full_train", "dataset, outer_seed", RET_NUMERIC, RET_CATEGORICAL
        ),
        "missing_by_column": _missing("ret", [*RET_NUMERIC, *RET_CATEGORICAL], "dataset"),
        "missing_both_sides": """
            SELECT CASE WHEN early THEN 'train' ELSE 'test' END AS dataset, 'month' AS "column",
              (count(*) - count(month))::BIGINT AS missing FROM shaped GROUP BY early
            HAVING count(*) > count(month)""",
        "constant_columns": _constants(),
        "feature_roles": _roles(),
        "dataset_status": """
            SELECT 'order-' || o_orderkey AS dataset, n_rows, n_classes, minority_rows,
              CASE WHEN n_rows IS NULL THEN 'unknown' WHEN n_classes < 2 THEN 'one_class'
                WHEN inf > 0 THEN 'infinite' WHEN minority_rows < 2 THEN 'too_few_rows'
                ELSE 'ok' END AS status
            FROM orders LEFT JOIN (
              SELECT l_orderkey, count(*) AS n_rows,
                (count(DISTINCT l_returnflag = 'R'))::BIGINT AS n_classes,
                CASE WHEN count(DISTINCT l_returnflag = 'R') = 1 THEN count(*)
                  ELSE least(count(*) FILTER (l_returnflag = 'R'),
                    count(*) FILTER (l_returnflag <> 'R')) END AS minority_rows,
                count(*) FILTER (l_tax = 0) AS inf
              FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey""",
        "class_counts": """
            SELECT dataset, y, count(*) AS class_rows FROM doc_quality GROUP BY ALL
            UNION ALL SELECT dataset, y, count(*) FROM doc_toxic GROUP BY ALL""",
        "audit_duplicates": _audit("signatures"),
        "audit_duplicates_hot": _audit(
            """(SELECT linestatus AS dataset, quantity, discount, tax, count(*) AS n,
                count(*) FILTER (y = 0) AS n0, count(*) FILTER (y = 1) AS n1 FROM ret
                GROUP BY linestatus, quantity, discount, tax)"""
        ),
        "conflicting_rows": """
            SELECT r.dataset, row_id, r.quantity, r.discount, r.tax, y FROM ret r
            JOIN signatures s ON r.dataset = s.dataset AND r.quantity = s.quantity
              AND r.discount IS NOT DISTINCT FROM s.discount AND r.tax IS NOT DISTINCT FROM s.tax
            WHERE n0 > 0 AND n1 > 0""",
        "predictor_overlap": _overlap("with_id", "id, status, priority, price_band, month")
        + " UNION ALL "
        + _overlap("without_id", "status, priority, price_band, month"),
        "shared_signatures": """
            SELECT status, priority, price_band, month FROM shaped WHERE early
            INTERSECT SELECT status, priority, price_band, month FROM shaped WHERE NOT early""",
        "target_summary": f"""
            SELECT o_orderstatus AS dataset, count(o_totalprice) AS target_count,
              {_r("min(o_totalprice)")} AS target_min, {_r("max(o_totalprice)")} AS target_max,
              {_r("avg(o_totalprice)")} AS target_mean,
              {_r("stddev_samp(o_totalprice)")} AS target_std
            FROM orders GROUP BY o_orderstatus""",
        "first_rows": """
            SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 5""",
        "stratified_holdout": "SELECT dataset, outer_seed, row_id, part FROM full_split",
        "stratified_kfold": """
            SELECT dataset, outer_seed, row_id, fold FROM full_split WHERE part = 'train'""",
        "fold_sizes": """
            SELECT dataset, outer_seed, fold, fold_rows, train_rows,
              train_rows // 3 + (fold < train_rows % 3)::INT AS expected_rows
            FROM (SELECT dataset, outer_seed, fold, count(*) AS fold_rows,
                    sum(count(*)) OVER (PARTITION BY dataset, outer_seed)::BIGINT AS train_rows
                  FROM full_split WHERE part = 'train' GROUP BY dataset, outer_seed, fold)""",
        "impute_stats": f"""
            SELECT dataset, cname AS "column", n_rows, n_missing, {_r("med")} AS median,
              n_missing > 0 AS has_indicator FROM medians""",
        "scaler_stats": f"""
            SELECT dataset, cname AS "column", {_r("avg(coalesce(v, med))")} AS imputed_mean,
              {_r("CASE WHEN stddev_pop(coalesce(v, med)) = 0 THEN 1.0 ELSE stddev_pop(coalesce(v, med)) END")} AS scale,
              {_r("avg((v IS NULL)::INT)")} AS indicator_mean,
              {_r("CASE WHEN stddev_pop((v IS NULL)::INT) = 0 THEN 1.0 ELSE stddev_pop((v IS NULL)::INT) END")} AS indicator_scale
            FROM long_ret JOIN medians USING (dataset, cname) GROUP BY dataset, cname""",
        "category_levels": """
            SELECT dataset, "column", level, count(*) AS level_rows,
              (row_number() OVER (PARTITION BY dataset, "column" ORDER BY level) - 1)::INT
                AS level_index
            FROM (SELECT dataset, 'linestatus' AS "column", linestatus AS level FROM ret
                  UNION ALL SELECT dataset, 'lang', lang FROM doc_quality
                  UNION ALL SELECT dataset, 'source', source FROM doc_quality)
            GROUP BY dataset, "column", level""",
        "encoded_design": _design(),
        "matrix_guard": """
            SELECT dataset, n_rows, width AS n_encoded_features, n_rows * width * 8 AS dense_bytes,
              CASE WHEN n_rows * width * 8 > 600 * 8 * 8 THEN 'too_large' ELSE 'ok' END AS status
            FROM ret_width""",
        "fold_widths": " UNION ALL ".join(_fold_width(s, k) for s in range(k + 1)),
        "work_list": f"""
            SELECT dataset, outer_seed, family, model, candidate_order, params_json, fold
            FROM (SELECT dataset FROM people) CROSS JOIN (VALUES {_values([(s,) for s in p.outer_seeds])})
              s(outer_seed) CROSS JOIN (SELECT family, model, candidate_order, params_json
                FROM full_candidates) CROSS JOIN (VALUES (0), (1), (2)) f(fold)""",
        "balanced_accuracy": f"""
            SELECT dataset, {_r("(count(*) FILTER (y = 0 AND quantity <= 25) / count(*) FILTER (y = 0)::DOUBLE + count(*) FILTER (y = 1 AND quantity > 25) / count(*) FILTER (y = 1)::DOUBLE) / 2")}
              AS balanced_accuracy FROM ret GROUP BY dataset""",
        "roc_auc_exact": f"""
            SELECT dataset, {_r("(sum(rk) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0::DOUBLE) / (count(*) FILTER (y = 1)::DOUBLE * count(*) FILTER (y = 0))")}
              AS roc_auc
            FROM (SELECT dataset, y, rank() OVER (PARTITION BY dataset ORDER BY score)
                    + (count(*) OVER (PARTITION BY dataset, score) - 1) / 2.0::DOUBLE AS rk
                  FROM (SELECT dataset, y, price AS score FROM ret
                        UNION ALL SELECT dataset, y, value FROM ev_purchase))
            GROUP BY dataset""",
        "trial_folds": f"""
            SELECT dataset, outer_seed, family, cells, stage, {_r("balanced_accuracy")}
              AS balanced_accuracy, {_r("roc_auc")} AS roc_auc, 'success' AS status
            FROM full_scores""",
        "trial_means": f"""
            SELECT dataset, outer_seed, family, candidate_order, 'success' AS status,
              3::INT AS completed_folds, {_r("mean_ba")} AS mean_balanced_accuracy,
              {_r("mean_auc")} AS mean_roc_auc FROM full_trials""",
        "select_candidate": f"""
            SELECT dataset, outer_seed, family, true AS all_trials_completed,
              candidate_order AS selected_candidate_order, {_r("mean_ba")}
              AS inner_balanced_accuracy, {_r("outer_ba")} AS balanced_accuracy,
              {_r("outer_auc")} AS roc_auc FROM full_winners""",
        "candidate_ranking": """
            SELECT dataset, outer_seed, family, candidate_order, candidate_rank::INT
              AS candidate_rank FROM full_ranked""",
        "paired_gap": f"""
            SELECT dataset, outer_seed, {_r("ba_g")} AS balanced_accuracy_gbdt,
              {_r("ba_d")} AS balanced_accuracy_mlp, {_r("auc_g")} AS roc_auc_gbdt,
              {_r("auc_d")} AS roc_auc_mlp, true AS paired_success, {_r("ba_d - ba_g")} AS {C.GAP}
            FROM full_pairs""",
        "meta_table": f"""
            SELECT dataset, openml_id, version, family, clinical, {meta_columns},
              actual_best_pipeline, near_tie_within_margin FROM meta""",
        "benchmark_index": """
            SELECT dataset, CASE WHEN clinical THEN 'skipped' WHEN o.dataset IS NULL
                THEN 'failure' ELSE 'success' END AS status,
              NOT clinical AND o.dataset IS NOT NULL AS research_valid,
              CASE WHEN clinical THEN 'clinical holdout' WHEN o.dataset IS NULL
                THEN 'unknown' END AS reason
            FROM people LEFT JOIN full_outcome o USING (dataset)""",
        "recommend_dummy_lofo": _evaluation("dummy_predicted"),
        "recommend_ridge1_lofo": _evaluation("ridge1_predicted"),
        "evaluation_summary": f"""
            SELECT 'dummy_mean' AS model, 0.01::DOUBLE AS margin, count(*) AS n_datasets,
              count(DISTINCT family) AS n_families,
              {_r("avg((rec = actual_best_pipeline)::INT)")} AS best_pipeline_accuracy,
              {_r(f"avg(best - CASE rec WHEN 'DNN' THEN {C.SCORE_DNN} ELSE {C.SCORE_GBDT} END)")}
                AS mean_regret,
              {_r(f"avg(best - {C.SCORE_GBDT})")} AS mean_regret_always_gbdt,
              {_r(f"avg(best - {C.SCORE_DNN})")} AS mean_regret_always_dnn,
              {_r(f"avg(best - CASE best_fixed WHEN 'DNN' THEN {C.SCORE_DNN} ELSE {C.SCORE_GBDT} END)")}
                AS mean_regret_best_fixed,
              {_r(f"sqrt(avg((predicted - {C.GAP}) * (predicted - {C.GAP})))")} AS rmse_gap
            FROM (SELECT *, greatest({C.SCORE_GBDT}, {C.SCORE_DNN}) AS best,
                    CASE WHEN predicted > 0.01 THEN 'DNN' ELSE 'GBDT' END AS rec
                  FROM dummy_predicted)
            JOIN (SELECT family, best_fixed FROM fixed) USING (family)""",
        "in_sample_dummy": f"""
            SELECT dataset, {_r("g")} AS predicted_gap,
              CASE WHEN g > 0.01 THEN 'DNN' ELSE 'GBDT' END AS recommendation,
              'In-sample fit; judge by held-out families instead.' AS warning
            FROM meta, (SELECT avg({C.GAP}) AS g FROM meta)""",
        "admission_ledger": """
            SELECT path, outcome, code, reason, validation_reason FROM ledger""",
        "admission_report": f"""
            SELECT 1::INT AS report_version, 'full' AS mode, false AS development_only,
              'reject all same-mode claims sharing dataset name or OpenML ID (any version)'
                AS duplicate_policy, count(*) AS input_count,
              count(*) FILTER (outcome = 'accepted') AS accepted_count,
              count(*) FILTER (outcome <> 'accepted') AS rejected_count FROM ledger""",
        "conflict_members": """
            SELECT kind, value, claimants, path, 0::INT AS occurrence
            FROM claims JOIN clashes USING (kind, value)""",
        "meta_from_evidence": f"""
            SELECT dataset, openml_id, version, family, clinical, {meta_columns},
              actual_best_pipeline, near_tie_within_margin
            FROM meta WHERE dataset IN (SELECT dataset FROM ledger WHERE outcome = 'accepted')""",
        "smoke_admission": """
            SELECT 'smoke' AS mode, dataset AS path, 'accepted' AS outcome, 'accepted' AS code,
              'All smoke evidence holds' AS reason FROM smoke_outcome
            UNION ALL SELECT 'full', dataset, 'rejected', 'invalid_result',
              'protocol.name: unexpected_value' FROM smoke_outcome""",
    }
    return {name: _query(sql) for name, sql in raw.items()}
