"""Admission of recorded benchmark runs: evidence rules and the duplicate policy.

A parsed record is cast once to a nested struct whose leaves stay VARIANT, so that every leaf keeps its
JSON type. It is then opened level by level: record, outer splits, the two families, their trials. On
each level the rules are plain columns, and the first broken one is a small struct of its position in the
document, its place and a code. The smallest struct of a record is its reason, so records are grouped
once, by path, after a map-side minimum.

Codes: ``missing``, ``wrong_kind``, ``out_of_range`` (or no number at all), ``unexpected_value``,
``unexpected_keys``, ``incomplete`` (a list that is not the whole numbered list), ``inconsistent`` (a value
that does not follow from others), ``error_recorded`` and ``too_large``.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..protocol import BASELINE, FULL, SMOKE, Protocol
from ..session import LONG_ROWS, stored
from ..sources import artifacts as A
from .trials import candidate_table

REPORT_VERSION = 1
DUPLICATE_POLICY = "reject all same-mode claims sharing dataset name or OpenML ID (any version)"

_MEANS = "meta_features_mean_over_outer_training_partitions"


def _struct(leaves: str, **nested: str) -> str:
    parts = [f"{name}: variant" for name in leaves.split()]
    parts += [f"{name}: {kind}" for name, kind in nested.items()]
    return f"struct<{', '.join(parts)}>"


_MAP = "map<string, variant>"
_SCORES = "balanced_accuracy roc_auc"
_TRIAL = _struct(
    "candidate_order status mean_balanced_accuracy mean_roc_auc fit_seconds error",
    params=_MAP,
    folds=f"array<{_struct('fold ' + _SCORES)}>",
    convergence_warnings="array<variant>",
)
_FAMILY = _struct(
    "family model all_trials_completed search_seconds refit_seconds selected_candidate_order "
    "inner_balanced_accuracy error",
    trials=f"array<{_TRIAL}>",
    refit_convergence_warnings="array<variant>",
    preprocessing_folds=(
        f"array<{_struct('fold n_encoded_features train_dense_bytes validation_dense_bytes')}>"
    ),
    best_params=_MAP,
    outer_scores=_struct(_SCORES),
    final_preprocessing=_struct("n_encoded_features train_dense_bytes test_dense_bytes"),
)
_SPLIT = _struct(
    f"outer_seed train_rows test_rows paired_success {C.GAP}",
    meta_features=_MAP,
    families=f"map<string, {_FAMILY}>",
)
RECORD_TYPE = _struct(
    "project research_valid status status_note",
    dataset=_struct("name openml_id version family clinical"),
    protocol=_MAP,
    outer_splits=f"array<{_SPLIT}>",
    aggregate=_struct(
        f"{C.SCORE_GBDT} {C.SCORE_DNN} {C.GAP} actual_best_pipeline near_tie_within_margin",
        **{_MEANS: _MAP},
    ),
)


# --- what a leaf may be -----------------------------------------------------------------


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def _text(v: Column) -> Column:
    return F.when(_kind(v) == "STRING", F.try_variant_get(v, "$", "string"))


def _flag(v: Column) -> Column:
    return F.when(_kind(v) == "BOOLEAN", F.try_variant_get(v, "$", "boolean"))


def _whole(v: Column) -> Column:
    """The value of an exact integer, else NULL."""
    return F.when(_kind(v) == "BIGINT", F.to_json(v).try_cast("bigint"))


def _real(v: Column) -> Column:
    """The value of a number, else NULL; booleans and texts are no numbers.

    Only a number reads as one in JSON, where a text has its quotes. Reading a variant as a double builds a cast
    per value, and a record has hundreds; only an infinite one needs it.
    """
    infinite = F.when(_kind(v) == "DOUBLE", F.try_variant_get(v, "$", "double"))
    return F.coalesce(F.to_json(v).try_cast("double"), infinite)


def _within(value: Column, low: float, high: float = float("inf")) -> Column:
    return (value >= low) & (value <= high) & (F.abs(value) < float("inf"))


def _counts(value: Column, low: int = 1) -> Column:
    return value.between(low, C.MAX_EXACT_INTEGER)


def _close(value: Column, expected: Column) -> Column:
    return F.abs(value - expected) <= C.ARITHMETIC_TOLERANCE


def _mean(values: Column, count: int) -> Column:
    """Left-to-right sum over a short array, then divided: exact ties stay ties."""
    return F.aggregate(values, F.lit(0.0), lambda total, v: total + v) / F.lit(float(count))


def _all(items: Column, holds) -> Column:
    """Whether something holds for every item; NULL counts as broken."""
    return F.forall(items, lambda x: F.coalesce(holds(x), F.lit(False)))


def _all_numbered(items: Column, holds) -> Column:
    """The same for a condition on an item and its position."""
    return _all(F.transform(items, lambda x, i: holds(x, i)), lambda h: h)


def _equals(v: Column, expected) -> Column:
    """Typed equality with a value of the protocol."""
    if isinstance(expected, bool):
        return _flag(v) == F.lit(expected)
    if isinstance(expected, str):
        return _text(v) == F.lit(expected)
    if isinstance(expected, int):
        return _whole(v) == F.lit(expected).cast("bigint")
    if isinstance(expected, float):
        return _real(v) == F.lit(expected)
    return _integers(v) == F.array(*[F.lit(x).cast("bigint") for x in expected])


def _integers(v: Column) -> Column:
    return F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x: _whole(x))


def _keys(m: Column) -> Column:
    return F.array_sort(F.map_keys(m))


def _sorted_names(names) -> Column:
    return F.array(*[F.lit(n) for n in sorted(names)])


# --- rules ------------------------------------------------------------------------------


@dataclass(frozen=True)
class Rule:
    """A condition that must hold; NULL counts as broken."""

    place: str
    code: str
    holds: Column


def _first_broken(rules: list[Rule]) -> Column:
    """Number of the first broken rule, NULL if all hold."""
    return F.coalesce(
        *[F.when(~F.coalesce(r.holds, F.lit(False)), F.lit(k)) for k, r in enumerate(rules)]
    )


def _reasons(rules: list[Rule]) -> Column:
    """Place and code of the rule whose number is in ``first.rule``."""
    texts = F.array(*[F.lit(f"{r.place}: {r.code}") for r in rules])
    return F.get(texts, F.col("first.rule"))


def _seconds(place: str, v: Column) -> Rule:
    return Rule(place, "out_of_range", _within(_real(v), 0.0))


def _score(place: str, v: Column) -> Rule:
    return Rule(place, "out_of_range", _within(_real(v), 0.0, 1.0))


def _texts(place: str, items: Column) -> Rule:
    return Rule(place, "wrong_kind", _all(items, lambda w: _kind(w) == "STRING"))


def _numbered(place: str, items: Column, count: int, key: str) -> Rule:
    """A list of ``count`` objects that carry their own positions."""
    positions = F.transform(items, lambda o: _whole(o[key]))
    wanted = F.array(*[F.lit(k).cast("bigint") for k in range(count)])
    return Rule(place, "incomplete", positions == wanted)


def _fits(m: Column, sizes: dict[str, Column]) -> Column:
    """Bytes of a dense matrix are rows times columns times 8."""
    width = _whole(m["n_encoded_features"])
    holds = _counts(width)
    for name, rows in sizes.items():
        exact = rows.cast("double") * width.cast("double") * C.FLOAT_BYTES
        holds = holds & (_whole(m[name]).cast("double") == exact)
    return holds


def _small(m: Column, sizes: dict[str, Column], limit: int) -> Column:
    return reduce(lambda a, b: a & b, [_whole(m[name]) <= limit for name in sizes])


def _same_params(given: Column, wanted: Column) -> Column:
    """Parameters of the family of the row, each of its own kind and nothing else."""
    cases = []
    for family, shape in BASELINE.items():
        holds = _keys(given) == _sorted_names(shape)
        for name, example in shape.items():
            v, read = given[name], _real
            if isinstance(example, tuple):
                read = _integers
            elif isinstance(example, int):
                read = _whole
            holds = holds & (read(v) == wanted[name])
        cases.append(F.when(F.col("family") == family, holds))
    return F.coalesce(*cases)


# --- levels of a record -----------------------------------------------------------------


def _header_rules(r: Column, p: Protocol, project: str) -> list[Rule]:
    data, protocol = r["dataset"], r["protocol"]
    rules = [
        Rule("project", "unexpected_value", _equals(r["project"], project)),
        Rule("dataset", "missing", data.isNotNull()),
    ]
    for name in ("name", "family"):
        rules.append(Rule(f"dataset.{name}", "missing", _text(data[name]).rlike(r"(?U)\S")))
    for name in ("openml_id", "version"):
        rules.append(Rule(f"dataset.{name}", "out_of_range", _counts(_whole(data[name]))))
    rules.append(Rule("dataset.clinical", "wrong_kind", _flag(data["clinical"]).isNotNull()))
    expected = p.as_record()
    rules.append(Rule("protocol", "unexpected_keys", _keys(protocol) == _sorted_names(expected)))
    for name, value in expected.items():
        rules.append(Rule(f"protocol.{name}", "unexpected_value", _equals(protocol[name], value)))
    return [
        *rules,
        Rule("status", "unexpected_value", _equals(r["status"], "success")),
        Rule("research_valid", "unexpected_value", _equals(r["research_valid"], p.name == "full")),
        Rule("status_note", "wrong_kind", _text(r["status_note"]).isNotNull()),
        Rule("outer_splits", "incomplete", F.size(r["outer_splits"]) == len(p.outer_seeds)),
    ]


def _outer(split: Column, family: str) -> Column:
    return _real(split["families"][family]["outer_scores"]["balanced_accuracy"])


def _closing_rules(r: Column, p: Protocol) -> list[Rule]:
    """What must agree over the splits, and the means and the winner."""
    splits, a, n = r["outer_splits"], r["aggregate"], len(p.outer_seeds)

    def agrees(value) -> Rule:
        return Rule("outer_splits", "inconsistent", F.size(F.array_distinct(F.transform(splits, value))) == 1)

    trees = _mean(F.transform(splits, lambda s: _outer(s, "GBDT")), n)
    net = _mean(F.transform(splits, lambda s: _outer(s, "DNN")), n)
    gap, means, place = net - trees, a[_MEANS], f"aggregate.{_MEANS}"

    def follows(e: Column) -> Column:
        own = F.transform(splits, lambda s: _real(s["meta_features"][e["key"]]))
        return _close(_real(e["value"]), _mean(own, n))

    return [
        agrees(lambda s: _whole(s["train_rows"])),
        agrees(lambda s: _whole(s["test_rows"])),
        agrees(lambda s: _whole(s["meta_features"]["n_features"])),
        Rule(f"aggregate.{C.SCORE_GBDT}", "inconsistent", _close(_real(a[C.SCORE_GBDT]), trees)),
        Rule(f"aggregate.{C.SCORE_DNN}", "inconsistent", _close(_real(a[C.SCORE_DNN]), net)),
        Rule(f"aggregate.{C.GAP}", "inconsistent", _close(_real(a[C.GAP]), gap)),
        Rule(
            "aggregate.actual_best_pipeline",
            "inconsistent",
            _text(a["actual_best_pipeline"]) == F.when(gap > 0, "DNN").otherwise("GBDT"),
        ),
        Rule(
            "aggregate.near_tie_within_margin",
            "inconsistent",
            _flag(a["near_tie_within_margin"]) == (F.abs(gap) <= p.recommendation_margin),
        ),
        Rule(
            place, "unexpected_keys", _all(splits, lambda s: _keys(means) == _keys(s["meta_features"]))
        ),
        Rule(place, "inconsistent", _all(F.map_entries(means), follows)),
    ]


def _split_rules(s: Column, seed: Column, p: Protocol) -> list[Rule]:
    m, place = s["meta_features"], ".meta_features"
    train, test = F.col("train"), F.col("test")
    real = {d: _real(m[d]) for d in C.DESCRIPTORS}
    names = F.map_keys(m)
    # Fractions are rounded counts, so ratios are taken from the counts they stand for.
    fewer = F.col("fewer")
    rules = [
        Rule(".outer_seed", "unexpected_value", _whole(s["outer_seed"]) == seed),
        Rule(".train_rows", "out_of_range", _counts(train, 2 * p.inner_folds)),
        Rule(".test_rows", "out_of_range", _counts(test, 2)),
        Rule(".test_rows", "inconsistent", test == F.ceil((train + test) * F.lit(p.test_size))),
        Rule(".paired_success", "unexpected_value", _equals(s["paired_success"], True)),
        Rule(place, "missing", F.size(F.array_except(_sorted_names(C.DESCRIPTORS), names)) == 0),
        Rule(place, "unexpected_keys", ~F.arrays_overlap(_sorted_names([*C.RESERVED_ROW_FIELDS, ""]), names)),
        Rule(place, "wrong_kind", _all(F.map_values(m), lambda v: F.abs(_real(v)) < float("inf"))),
    ]
    for d in ("n_samples", "n_features", "n_classes"):
        rules.append(Rule(f"{place}.{d}", "out_of_range", _counts(_whole(m[d]))))
    for d in C.DESCRIPTORS:
        if d.endswith("_fraction"):
            top = 0.5 if d == "minority_class_fraction" else 1.0
            rules.append(Rule(f"{place}.{d}", "out_of_range", _within(real[d], 0.0, top)))
    follows = {
        "n_samples": real["n_samples"] == train,
        "n_classes": real["n_classes"] == 2,
        "samples_per_feature": _close(
            real["samples_per_feature"], F.try_divide(train.cast("double"), real["n_features"])
        ),
        "minority_class_fraction": (fewer >= p.inner_folds)
        & _close(real["minority_class_fraction"], F.try_divide(fewer, train.cast("double"))),
        "imbalance_ratio": (fewer * 2 <= train)
        & _close(real["imbalance_ratio"], F.try_divide(train - fewer, fewer)),
    }
    rules += [Rule(f"{place}.{d}", "inconsistent", holds) for d, holds in follows.items()]
    gap = _outer(s, "DNN") - _outer(s, "GBDT")
    return [
        *rules,
        Rule(".families", "unexpected_keys", _keys(s["families"]) == _sorted_names(C.FAMILIES)),
        Rule(f".{C.GAP}", "inconsistent", _close(_real(s[C.GAP]), gap)),
    ]


def _fold_rows(train: Column, fold: Column, folds: int) -> Column:
    return F.floor(train / F.lit(folds)) + (train % folds > fold).cast("bigint")


def _family_rules(v: Column, best: Column, wanted: Column, p: Protocol) -> list[Rule]:
    train, test, k, limit = F.col("train"), F.col("test"), p.inner_folds, p.matrix_limit_bytes
    models = F.create_map(*[F.lit(x) for pair in C.MODEL_OF_FAMILY.items() for x in pair])
    last = {"train_dense_bytes": train, "test_dense_bytes": test}

    def parts(fold: Column) -> dict[str, Column]:
        held = _fold_rows(train, fold, k)
        return {"train_dense_bytes": train - held, "validation_dense_bytes": held}

    folds, final = v["preprocessing_folds"], v["final_preprocessing"]
    selected = _whole(v["selected_candidate_order"])
    return [
        Rule(".family", "unexpected_value", _text(v["family"]) == F.col("family")),
        Rule(".model", "unexpected_value", _text(v["model"]) == models[F.col("family")]),
        Rule(".all_trials_completed", "unexpected_value", _equals(v["all_trials_completed"], True)),
        Rule(".error", "error_recorded", F.is_variant_null(v["error"])),
        _seconds(".search_seconds", v["search_seconds"]),
        _seconds(".refit_seconds", v["refit_seconds"]),
        _texts(".refit_convergence_warnings", v["refit_convergence_warnings"]),
        _numbered(".preprocessing_folds", folds, k, "fold"),
        Rule(".preprocessing_folds", "inconsistent", _all_numbered(folds, lambda m, i: _fits(m, parts(i)))),
        Rule(".preprocessing_folds", "too_large", _all_numbered(folds, lambda m, i: _small(m, parts(i), limit))),
        _numbered(".trials", v["trials"], p.candidate_count, "candidate_order"),
        Rule(".selected_candidate_order", "inconsistent", selected == -best["behind"]),
        Rule(".best_params", "inconsistent", _same_params(v["best_params"], wanted)),
        Rule(
            ".inner_balanced_accuracy",
            "inconsistent",
            _close(_real(v["inner_balanced_accuracy"]), best["mean"]),
        ),
        Rule(".final_preprocessing", "inconsistent", _fits(final, last)),
        Rule(".final_preprocessing", "too_large", _small(final, last, limit)),
        _score(".outer_scores.balanced_accuracy", v["outer_scores"]["balanced_accuracy"]),
        _score(".outer_scores.roc_auc", v["outer_scores"]["roc_auc"]),
    ]


def _fold_scores(t: Column, metric: str) -> Column:
    return F.transform(t["folds"], lambda g: _real(g[metric]))


def _trial_rules(trial: Column, wanted: Column, p: Protocol) -> list[Rule]:
    """Rules of one trial ``t``, whose fold scores have been read before."""
    t = trial["t"]
    rules = [
        Rule(".params", "unexpected_value", _same_params(t["params"], wanted)),
        Rule(".status", "unexpected_value", _equals(t["status"], "success")),
        Rule(".error", "error_recorded", F.is_variant_null(t["error"])),
        _seconds(".fit_seconds", t["fit_seconds"]),
        _texts(".convergence_warnings", t["convergence_warnings"]),
        _numbered(".folds", t["folds"], p.inner_folds, "fold"),
    ]
    for metric in _SCORES.split():
        own = trial[metric]
        mean = _mean(own, p.inner_folds)
        rules += [
            Rule(f".folds.{metric}", "out_of_range", _all(own, lambda x: _within(x, 0.0, 1.0))),
            Rule(f".mean_{metric}", "inconsistent", _close(_real(t[f"mean_{metric}"]), mean)),
        ]
    return rules


def _at(rule: Column, section: int, **position) -> Column:
    """Position of a broken rule in the document; an outer level comes before the inner ones."""
    parts = [F.lit("section"), F.lit(section)]
    for name in ("split", "family", "trial"):
        parts += [F.lit(name), position.get(name, F.lit(-1)).cast("int")]
    return F.when(rule.isNotNull(), F.named_struct(*parts, F.lit("rule"), rule))


def _broken(typed: DataFrame, p: Protocol, project: str) -> DataFrame:
    """(path, occurrence, reason) of each record that breaks a rule: the first one it breaks."""
    spark, key = typed.sparkSession, ["path", "occurrence"]
    header = _header_rules(F.col("record"), p, project)
    closing = _closing_rules(F.col("record"), p)
    splits = typed.select(
        *key,
        F.least(_at(_first_broken(header), 0), _at(_first_broken(closing), 2)).alias("outside"),
        F.posexplode_outer("record.outer_splits").alias("i", "s"),
    ).withColumns({"train": _whole(F.col("s.train_rows")), "test": _whole(F.col("s.test_rows"))})
    minority = _real(F.col("s.meta_features")["minority_class_fraction"])
    splits = splits.withColumn("fewer", F.bround(minority * F.col("train")))
    seeds = F.array(*[F.lit(x).cast("bigint") for x in p.outer_seeds])
    own = _split_rules(F.col("s"), F.get(seeds, F.col("i")), p)
    opened = F.array(
        *[
            F.named_struct(
                F.lit("f"), F.lit(k), F.lit("family"), F.lit(f), F.lit("v"), F.col("s")["families"][f]
            )
            for k, f in enumerate(C.FAMILIES)
        ]
    )
    families = splits.select(
        *key, "outside", "i", "train", "test",
        F.when(F.col("i").isNotNull(), _at(_first_broken(own), 1, split=F.col("i"))).alias("in_split"),
        F.explode(opened).alias("e"),
    ).select(*key, "outside", "in_split", "i", "train", "test", "e.*")
    # Fold scores are read once, for the winner of a search and for the rules of its trials.
    scored = F.transform(
        F.col("v.trials"),
        lambda t: F.struct(t.alias("t"), *[_fold_scores(t, m).alias(m) for m in _SCORES.split()]),
    )
    best = F.array_max(
        F.transform(
            F.col("scored"),
            lambda t, k: F.struct(
                _mean(t["balanced_accuracy"], p.inner_folds).alias("mean"), (-k).alias("behind")
            ),
        )
    )
    # The candidates of a protocol: at most 81 rows, whatever the data.
    drawn = F.broadcast(
        candidate_table(spark, p).select(
            F.col("family").alias("of"), F.col("candidate_order").alias("at"), F.col("params").alias("wanted")
        )
    )
    families = families.withColumn("scored", scored).withColumn("best", best)
    chosen = (F.col("family") == F.col("of")) & (F.col("at") == -F.col("best.behind"))
    families = families.join(drawn, chosen, "left").drop("of", "at")
    inner = _family_rules(F.col("v"), F.col("best"), F.col("wanted"), p)
    trials = families.select(
        *key, "outside", "in_split", "i", "family", "f",
        F.when(
            F.col("i").isNotNull(), _at(_first_broken(inner), 1, split=F.col("i"), family=F.col("f"))
        ).alias("in_family"),
        F.posexplode_outer("scored").alias("j", "t"),
    )
    trials = trials.join(drawn, (F.col("family") == F.col("of")) & (F.col("at") == F.col("j")), "left")
    innermost = _trial_rules(F.col("t"), F.col("wanted"), p)
    at = dict(split=F.col("i"), family=F.col("f"), trial=F.col("j"))
    in_trial = F.when(F.col("j").isNotNull(), _at(_first_broken(innermost), 1, **at))
    first = F.least("outside", "in_split", "in_family", in_trial)
    found = trials.select(*key, first.alias("first")).groupBy(*key).agg(F.min("first").alias("first"))
    family = F.get(F.array(*[F.lit(f) for f in C.FAMILIES]), F.col("first.family"))
    place = F.concat(
        F.format_string("outer_splits[%d]", "first.split"),
        F.when(F.col("first.family") >= 0, F.concat(F.lit(".families."), family)).otherwise(""),
        F.when(F.col("first.trial") >= 0, F.format_string(".trials[%d]", "first.trial")).otherwise(""),
    )
    level = (
        F.when(F.col("first.trial") >= 0, _reasons(innermost))
        .when(F.col("first.family") >= 0, _reasons(inner))
        .otherwise(_reasons(own))
    )
    reason = (
        F.when(F.col("first.section") == 0, _reasons(header))
        .when(F.col("first.section") == 2, _reasons(closing))
        .otherwise(F.concat(place, level))
    )
    return found.where("first IS NOT NULL").select(*key, reason.alias("reason"))


# --- selection --------------------------------------------------------------------------


def _identity(r: Column, p: Protocol, project: str) -> Column:
    """Claimed name, source id and version of a record of this project and mode."""
    data = r["dataset"]
    mine = _equals(r["project"], project) & _equals(r["protocol"]["name"], p.name) & data.isNotNull()

    def positive(name: str) -> Column:
        return F.when(_whole(data[name]) > 0, _whole(data[name])).alias(name)

    name = F.when(_text(data["name"]).rlike(r"(?U)\S"), _text(data["name"])).alias("name")
    return F.when(mine, F.struct(name, positive("openml_id"), positive("version")))


def validate(artifacts: DataFrame, p: Protocol = FULL, project: str = C.PROJECT) -> DataFrame:
    """(path, occurrence, doc, identity, code, reason) of each record on its own.

    Parsed records are stored: the rules and the result both read them, and parsing asks for whole texts.
    """
    if p not in (FULL, SMOKE):
        raise ValueError("Records are admitted under the full or the smoke protocol only.")
    typed = stored(A.parse(artifacts), LONG_ROWS).withColumn("record", F.try_variant_get("doc", "$", RECORD_TYPE))
    parsed = typed.where("code IS NULL").select("path", "occurrence", "record")
    broken = _broken(parsed, p, project).select(
        F.col("path").alias("of"), F.col("occurrence").alias("at"), F.col("reason").alias("broken")
    )
    # Every leaf of a typed record has the names of the whole document with it, so only the identity is joined.
    claimed = typed.select("path", "occurrence", "doc", "code", _identity(F.col("record"), p, project).alias("identity"))
    judged = claimed.join(
        broken, (F.col("path") == F.col("of")) & (F.col("occurrence") == F.col("at")), "left"
    )
    plain = F.when(F.col("code") == "unreadable_input", "Unreadable input").when(
        F.col("code") == "malformed_json", "Malformed JSON"
    )
    return judged.select(
        "path",
        "occurrence",
        "doc",
        "identity",
        F.coalesce(
            F.col("code"), F.when(F.col("broken").isNotNull(), "invalid_result"), F.lit("accepted")
        ).alias("code"),
        F.coalesce(plain, "broken", F.lit(f"All {p.name} evidence holds")).alias("reason"),
    )


def _claims(validated: DataFrame) -> DataFrame:
    """(kind, value, path, occurrence): every name or source id an artifact claims."""
    kinds = F.array(
        F.struct(F.lit("name").alias("kind"), F.col("identity.name").alias("value")),
        F.struct(
            F.lit("openml_id").alias("kind"),
            F.col("identity.openml_id").cast("string").alias("value"),
        ),
    )
    return (
        validated.select("path", "occurrence", F.explode(kinds).alias("claim"))
        .filter("claim.value IS NOT NULL")
        .select("claim.kind", "claim.value", "path", "occurrence")
    )


def conflict_groups(validated: DataFrame) -> DataFrame:
    """(kind, value, claimants) of identities claimed more than once."""
    return (
        _claims(validated)
        .groupBy("kind", "value")
        .agg(F.count(F.lit(1)).alias("claimants"))
        .filter("claimants > 1")
    )


def conflict_members(validated: DataFrame) -> DataFrame:
    """(kind, value, claimants, path, occurrence): every member of every conflict, one row each."""
    return _claims(validated).join(conflict_groups(validated), ["kind", "value"])


def ledger(validated: DataFrame) -> DataFrame:
    """Final outcome of every input after the duplicate policy.

    All inputs claiming a shared name or source id are rejected, valid or not, and keep their
    earlier reason in ``validation_reason``. Links are direct, without transitive closure. A reason
    names each shared identity and its number of claims; ``conflict_members`` lists the claims.
    """
    linked = (
        conflict_members(validated)
        .groupBy("path", "occurrence")
        .agg(F.array_sort(F.collect_list(F.struct("kind", "value", "claimants"))).alias("conflicts"))
    )
    text = F.concat(
        F.lit("identity claimed more than once: "),
        F.array_join(
            F.transform(
                "conflicts",
                lambda c: F.concat(
                    c["kind"], F.lit("="), c["value"], F.lit(" ("), c["claimants"].cast("string"),
                    F.lit(" claims)"),
                ),
            ),
            ", ",
        ),
    )
    clash = F.col("conflicts").isNotNull()
    return (
        validated.join(linked, ["path", "occurrence"], "left")
        .withColumn(
            "validation_reason",
            F.when(clash & (F.col("code") != "accepted"), F.col("reason")),
        )
        .withColumn("reason", F.when(clash, text).otherwise(F.col("reason")))
        .withColumn("code", F.when(clash, "duplicate_identity").otherwise(F.col("code")))
        .withColumn(
            "outcome", F.when(F.col("code") == "accepted", "accepted").otherwise("rejected")
        )
        .select(
            "path", "occurrence", "outcome", "code", "reason", "validation_reason", "identity", "doc"
        )
    )


def report_summary(entries: DataFrame, p: Protocol) -> DataFrame:
    """One row: counts and policy of a selection."""
    accepted = F.count_if(F.col("outcome") == "accepted")
    return entries.agg(
        F.count(F.lit(1)).alias("input_count"),
        accepted.alias("accepted_count"),
        (F.count(F.lit(1)) - accepted).alias("rejected_count"),
    ).select(
        F.lit(REPORT_VERSION).alias("report_version"),
        F.lit(p.name).alias("mode"),
        F.lit(p.name == "smoke").alias("development_only"),
        F.lit(DUPLICATE_POLICY).alias("duplicate_policy"),
        "*",
    )


def meta_rows(entries: DataFrame, p: Protocol) -> DataFrame:
    """One meta-table row per accepted artifact, extra descriptors in a map.

    Smoke rows are marked as development-only.
    """

    def at(path: str, kind: str) -> Column:
        return F.try_variant_get(F.col("doc"), path, kind)

    means = "$.aggregate.meta_features_mean_over_outer_training_partitions"
    everything = at(means, "map<string,double>")
    ten = F.array(*[F.lit(d) for d in C.DESCRIPTORS])
    rows = entries.filter("outcome = 'accepted'").select(
        at("$.dataset.name", "string").alias("dataset"),
        at("$.dataset.openml_id", "bigint").alias("openml_id"),
        at("$.dataset.version", "bigint").alias("version"),
        at("$.dataset.family", "string").alias("family"),
        at("$.dataset.clinical", "boolean").alias("clinical"),
        *[at(f"{means}.{d}", "double").alias(d) for d in C.DESCRIPTORS],
        F.map_filter(everything, lambda k, _: ~F.array_contains(ten, k)).alias("extra_descriptors"),
        *[at(f"$.aggregate.{c}", "double").alias(c) for c in (C.SCORE_GBDT, C.SCORE_DNN, C.GAP)],
        at("$.aggregate.actual_best_pipeline", "string").alias("actual_best_pipeline"),
        at("$.aggregate.near_tie_within_margin", "boolean").alias("near_tie_within_margin"),
    )
    if p.name == "smoke":
        rows = rows.withColumns({"development_only": F.lit(True), "result_mode": F.lit("smoke")})
    return rows


class NoAcceptedResults(ValueError):
    """Every input was rejected; the ledger has been written all the same."""


def build_meta_table(
    artifacts: DataFrame,
    p: Protocol = FULL,
    project: str = C.PROJECT,
    report_path: str | None = None,
) -> DataFrame:
    """Admit artifacts and return the meta-table; the ledger is written before any error.

    Validation, the slowest step, runs once: its outcome is stored.
    """
    entries = ledger(stored(validate(artifacts, p, project), LONG_ROWS))
    if report_path is not None:
        entries.drop("doc").withColumn("identity", F.to_json("identity")).write.mode(
            "errorifexists"
        ).json(report_path)
    rows = meta_rows(entries, p)
    if rows.isEmpty():
        raise NoAcceptedResults(f"No accepted canonical {p.name} results.")
    return rows

