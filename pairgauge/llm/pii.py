"""Personal data by candidates and boosted trees; built-in functions and Spark ML only.

1. Generators, the four base patterns and looser ones, propose spans that may overlap. They run once over
   each whole text; what they find is stored with one row per document.
2. Base spans are the valid matches of the base patterns. Positive examples are base spans, what overlaps one
   of its kind, and perturbed base spans in their own context: a phone without its sign or country code and
   with other separators, an address whose signs are spelled, a card with a mistyped digit. Negative are the
   matches of base patterns whose form is wrong (parts above 255, too few or too many digits). All other
   finds are unlabelled: a little weight against them in the fit, none in the calibration.
3. Format and context of a candidate are twelve yes-or-no features, so all candidates of all documents
   reduce to counts per (generator, features): at most 6 * 4096 rows whatever the data. Boosted trees
   are fitted on these weighted rows.
4. A threshold per kind is the lowest score, one half at least, at which the labelled and perturbed candidates
   of a fifth of the documents, which the trees have not seen, reach the precision wanted. Candidates above
   it join the base spans unless they overlap one.

Patterns never match a line break and use possessive repeats, so long texts cost linear time.

Defined cases: a null or empty text has no spans; repeated rows are searched one by one; ids may be null;
without positive or negative examples only base spans are returned; other columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import picked, stored

KINDS = ("email", "ip", "card", "phone")
PRECISION = 0.95
TREES = 10
DEPTH = 3
FEATURES = 12
#: Weight against a find that is neither like a base span nor wrong in form.
UNLABELLED = 0.05
LEAST_SCORE = 0.5

_LOCAL = "[A-Za-z0-9._%+-]"
_HOST = "[A-Za-z0-9-]"
#: Kind, pattern and a sign without which it cannot match. The first four are the base patterns; a match
#: can only begin where a run begins or where the last match ended, which spares quadratic searches.
GENERATORS: tuple[tuple[str, str, str], ...] = (
    ("email", rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@{_HOST}++(?:\.{_HOST}++)++", "@"),
    ("ip", r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "."),
    ("card", r"[0-9](?:[0-9]|[ -][0-9])++", ""),
    ("phone", r"\+[0-9][ ().0-9-]+[0-9]", "+"),
    (
        "email",
        rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++ ?(?:[(\[]at[)\]]|[(\[]@[)\]]) ?{_HOST}++"
        rf"(?: ?(?:\.|[(\[]dot[)\]]) ?{_HOST}++)++",
        "t",
    ),
    ("phone", r"(?:(?<![0-9])|\G)\(?[0-9]{2,4}\)?(?:[ ./-]\(?[0-9]{2,4}\)?){2,4}(?![0-9])", ""),
)
BASE = 4
_CONTACT = r"(?:mail|contact|write|tel|phone|call|fax|mobile|sms|ip|host|address|server|card|visa|credit|pay)"


def _found(number: int, kind: str, sign: str) -> Column:
    """Candidates of one generator in one text, in order, with their surroundings."""
    text, match = F.col(f"_m{number}"), F.col(f"_p{number}")
    return F.transform(
        text,
        lambda m, i: F.struct(
            F.lit(number).alias("generator"),
            i.cast("int").alias("number"),
            F.length(F.get(match, i)).alias("gap"),
            m.alias("match"),
            F.lower(F.right(F.get(match, i), F.lit(24))).alias("before"),
            F.left(F.get(match, i + 1), F.lit(1)).alias("after"),
        ),
    )


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, row, row_key and the array of everything the generators find in a document."""
    rows = picked(docs, doc_id=id_col, text=text_col).select(
        "doc_id",
        F.monotonically_increasing_id().alias("row"),
        F.xxhash64("doc_id", "text").alias("row_key"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    digits = F.col("text").rlike("[0-9]")
    made = []
    for number, (_, pattern, sign) in enumerate(GENERATORS):
        here = F.col("text").rlike(pattern)
        here = (F.contains("text", F.lit(sign)) if sign else digits) & here
        made.append(F.when(here, F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias(f"_m{number}"))
        made.append(F.when(here, F.split("text", pattern, -1)).alias(f"_p{number}"))
    rows = rows.select("doc_id", "row", "row_key", *made)
    none = F.array().cast(
        "array<struct<generator:int,number:int,gap:int,match:string,before:string,after:string>>"
    )
    parts = [F.coalesce(_found(n, k, s), none) for n, (k, _, s) in enumerate(GENERATORS)]
    return rows.select("doc_id", "row", "row_key", F.concat(*parts).alias("found"))


def _luhn(digits: Column) -> Column:
    """Whether the digits, at most 19, pass the Luhn check."""
    def weighed(total: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int") * (1 + i % 2)
        return total + F.when(d > 9, d - 9).otherwise(d)

    total = F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), weighed)
    return total % 10 == 0


def located(found: DataFrame) -> DataFrame:
    """One row per candidate: kind, start, end, whether it is a base span, and its feature bits."""
    rows = found.select("row", "row_key", F.explode("found").alias("c")).select("row", "row_key", "c.*")
    line = Window.partitionBy("row", "generator").orderBy("number")
    length = F.length("match")
    end = F.sum(F.col("gap") + length).over(line).cast("bigint")
    kind = F.element_at(F.array(*[F.lit(KINDS.index(k)) for k, _, _ in GENERATORS]), F.col("generator") + 1)
    digits = F.regexp_replace("match", "[^0-9]", "")
    count = F.length(digits)
    part = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
    valid = (
        F.when(F.col("generator") == 0, True)
        .when(F.col("generator") == 1, F.col("match").rlike(rf"^{part}(?:\.{part}){{3}}$"))
        .when(F.col("generator") == 2, F.when(count.between(12, 19), _luhn(digits)).otherwise(False))
        .when(F.col("generator") == 3, count.between(9, 15))
        .otherwise(False)
    )
    wrong = F.when(F.col("generator") == 2, ~count.between(12, 19)).when(F.col("generator") < BASE, ~valid)
    kept = [F.when(valid, F.col(c)).alias(c) for c in ("match", "before", "after")]
    return rows.select(
        "row", "row_key", "generator", kind.alias("kind"), (end - length).alias("start"), end.alias("end"),
        valid.alias("base"), F.coalesce(wrong, F.lit(False)).alias("wrong"),
        _bits(F.col("match"), F.col("before"), F.col("after")).alias("bits"), *kept,
    )


def _bits(match: Column, before: Column, after: Column) -> Column:
    """Format and context as twelve bits."""
    count = F.length(F.regexp_replace(match, "[^0-9]", ""))
    signs = [
        F.contains(match, F.lit("@")),
        match.startswith("+"),
        count >= 9,
        count >= 12,
        count.between(13, 16),
        match.rlike("[ -]"),
        F.contains(match, F.lit(".")),
        match.rlike(r"[()]"),
        before.rlike(_CONTACT + r"\W{0,4}$"),
        before.rlike(r"\w$"),
        after.rlike(r"\w"),
        match.rlike(r"^[0-9]{4}(?:[ -]?[0-9]{4})++$"),
    ]
    return sum((F.coalesce(s, F.lit(False)).cast("int") * (1 << k) for k, s in enumerate(signs)), F.lit(0))


def perturbed(base: DataFrame) -> DataFrame:
    """row_key, generator, kind and bits of what base spans would look like if written more loosely.

    Only forms that the looser generator itself would propose are examples.
    """
    match = F.col("match")
    bare = F.regexp_replace(match, r"^\+[0-9]{1,3}[ .-]*", "")
    phones = [
        F.regexp_replace(match, r"^\+", ""), bare, F.regexp_replace(bare, "[ -]", "."), F.regexp_replace(bare, "[ .]", "-"),
    ]
    local, host = F.substring_index(match, "@", 1), F.substring_index(match, "@", -1)
    emails = [
        form
        for name in (local, F.regexp_replace(local, "[.]", ""))
        for form in (
            F.concat(name, F.lit(" (at) "), F.replace(host, F.lit("."), F.lit(" (dot) "))),
            F.concat(name, F.lit("[at]"), F.replace(host, F.lit("."), F.lit("[dot]"))),
            F.concat(name, F.lit(" [at] "), host),
        )
    ]
    # A mistyped digit changes no sign of the form.
    forms = (
        F.when(F.col("generator") == 3, F.array(*phones))
        .when(F.col("generator") == 0, F.array(*emails))
        .when(F.col("generator") == 2, F.array(match))
    )
    by = F.when(F.col("generator") == 3, 5).when(F.col("generator") == 0, 4).otherwise(F.col("generator"))
    rows = base.select("row_key", "kind", by.alias("generator"), "before", "after", F.explode(F.array_distinct(forms)).alias("match"))
    found = F.lit(False)
    for number, (_, pattern, _) in enumerate(GENERATORS):
        # Before and after a whole string there is nothing for the surroundings of a pattern to see.
        found = found | ((F.col("generator") == number) & match.rlike(f"^(?:{pattern})$"))
    return rows.where(found).select("row_key", "generator", "kind", _bits(match, F.col("before"), F.col("after")).alias("bits"))


def _touching(scope: list[str]) -> Column:
    """Whether a span overlaps a base span of its scope, itself included."""
    line = Window.partitionBy(*scope).orderBy("start", "end")
    back = line.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    past = line.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = line.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    reached = F.greatest(
        F.max(F.when(F.col("base"), F.col("end"))).over(back),
        F.max(F.when(F.col("base"), F.col("end"))).over(past),
    )
    coming = F.min(F.when(F.col("base"), F.col("start"))).over(ahead)
    return F.coalesce(reached > F.col("start"), F.lit(False)) | F.coalesce(coming < F.col("end"), F.lit(False))


def _scored(patterns: DataFrame) -> DataFrame | None:
    """Score of every (generator, bits), or None without examples of both kinds."""
    fitting = patterns.where("NOT held_out")
    sums = fitting.agg(F.sum("positive"), F.sum("negative")).first()
    if not sums[0] or not sums[1]:
        return None
    names = [f"f{k}" for k in range(FEATURES)]
    features = [F.shiftright("bits", k).bitwiseAND(1).cast("double").alias(f"f{k}") for k in range(FEATURES)]
    kinds = [(F.col("generator") == g).cast("double").alias(f"g{g}") for g in range(len(GENERATORS))]
    names += [f"g{g}" for g in range(len(GENERATORS))]
    assembler = VectorAssembler(inputCols=names, outputCol="features")
    every = assembler.transform(patterns.select("*", *features, *kinds))
    examples = every.where("NOT held_out").select(
        "features",
        F.explode(
            F.array(
                F.struct(F.lit(1.0).alias("label"), F.col("positive").alias("weight")),
                F.struct(F.lit(0.0).alias("label"), F.col("negative").alias("weight")),
            )
        ).alias("e"),
    )
    examples = stored(examples.select("features", "e.*").where("weight > 0").coalesce(1))
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, maxBins=8, stepSize=0.3, weightCol="weight", seed=3)
    model = trees.fit(examples)
    return model.transform(every).select(
        "generator", "bits", "kind", "held_out", "positive", "wrong",
        F.round(vector_to_array("probability")[1], 9).alias("score"),
    )


def spans(found: DataFrame, precision: float = PRECISION) -> DataFrame:
    """All chosen spans of a stored table of candidates: row, kind, start, end, base and score."""
    rows = stored(located(found).withColumn("touches", _touching(["row", "kind"])))
    fold = F.pmod(F.xxhash64("row_key"), F.lit(5)) == 0
    like = F.col("touches").cast("double")
    wrong = (F.col("wrong") & ~F.col("touches")).cast("double")
    labelled = rows.select("generator", "kind", "bits", fold.alias("held_out"), like.alias("like"), wrong.alias("wrong"))
    loose = perturbed(rows.where("base")).select(
        "generator", "kind", "bits", fold.alias("held_out"), F.lit(1.0).alias("like"), F.lit(0.0).alias("wrong")
    )
    patterns = stored(
        labelled.union(loose).groupBy("generator", "kind", "bits", "held_out").agg(
            F.sum("like").alias("positive"),
            F.sum("wrong").alias("wrong"),
            F.sum(F.col("wrong") + (1 - F.col("like") - F.col("wrong")) * UNLABELLED).alias("negative"),
        )
    )
    scores = _scored(patterns)
    base = rows.where("base").select("row", "kind", "start", "end", "base", F.lit(1.0).alias("score"))
    if scores is None:
        return base
    scores = stored(scores)
    down = Window.partitionBy("kind").orderBy(F.desc("score"))
    so_far = scores.where("held_out").withColumn(
        "precision", F.try_divide(F.sum("positive").over(down), F.sum(F.col("positive") + F.col("wrong")).over(down))
    )
    sure = so_far.where((F.col("precision") >= precision) & (F.col("positive") > 0)).groupBy("kind")
    limits = sure.agg(F.greatest(F.min("score"), F.lit(LEAST_SCORE)).alias("limit"))
    chosen = scores.groupBy("generator", "kind", "bits").agg(F.max("score").alias("score"))
    chosen = chosen.join(limits, "kind").where("score >= limit").drop("limit", "kind")
    extra = rows.where("NOT base").join(stored(chosen), ["generator", "bits"])
    extra = extra.select("row", "kind", "start", "end", "base", "score")
    both = base.union(extra).groupBy("row", "kind", "start", "end").agg(
        F.max("base").alias("base"), F.max("score").alias("score")
    )
    both = both.withColumn("touches", _touching(["row"]))
    return both.where("base OR NOT touches").drop("touches")


def _listed(which: Column) -> Column:
    """kind:start:end of the spans, by start, then kind in the order of ``KINDS``, then end."""
    names = F.array(*[F.lit(k) for k in KINDS])
    ordered = F.sort_array(F.collect_list(F.when(which, F.struct("start", "kind", "end"))))
    text = F.transform(
        ordered, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])
    )
    return F.concat_ws(",", text)


def find(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", precision: float = PRECISION
) -> DataFrame:
    """Base counts, base spans and all spans of every document, and ``row_key`` naming id and text."""
    found = stored(candidates(docs, id_col, text_col))
    chosen = spans(found, precision)
    counts = [F.sum((F.col("base") & (F.col("kind") == k)).cast("bigint")).alias(f"n_{n}") for k, n in enumerate(KINDS)]
    byrow = chosen.groupBy(F.col("row").alias("of")).agg(
        *counts,
        _listed(F.col("base")).alias("base_spans"),
        _listed(F.lit(True)).alias("spans"),
        F.sort_array(F.collect_list(F.struct("start", "end", "kind"))).alias("places"),
    )
    out = found.select("doc_id", "row", "row_key").join(byrow, F.col("row") == F.col("of"), "left")
    return out.select(
        "doc_id",
        *[F.coalesce(f"n_{n}", F.lit(0)).cast("bigint").alias(f"n_{n}") for n in KINDS],
        F.coalesce("base_spans", F.lit("")).alias("base_spans"),
        F.coalesce("spans", F.lit("")).alias("spans"),
        "places",
        "row_key",
    )


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with every chosen span replaced by its kind in brackets; other columns as they are.

    Where chosen spans overlap, the earlier one is replaced and the rest of the later one with it.
    """
    places = find(docs, id_col, text_col).where("places IS NOT NULL")
    places = stored(places.groupBy("row_key").agg(F.any_value("places").alias("_places")))
    places = places.withColumnRenamed("row_key", "_key")
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    rows = docs.withColumn("_own", F.xxhash64(id_col, text_col))
    rows = rows.join(places, F.col("_own") == F.col("_key"), "left")
    text = F.col(text_col)

    def step(done: Column, s: Column) -> Column:
        new = s["start"] >= done["at"]
        gap = F.substring(text, (done["at"] + 1).cast("int"), F.greatest(s["start"] - done["at"], F.lit(0)).cast("int"))
        return F.struct(
            F.greatest(done["at"], s["end"]).alias("at"),
            F.concat(done["made"], F.when(new, F.concat(gap, F.element_at(names, s["kind"] + 1))).otherwise("")).alias("made"),
        )

    clean = F.aggregate(
        "_places",
        F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("made")),
        step,
        lambda done: F.concat(done["made"], F.substring(text, (done["at"] + 1).cast("int"), F.length(text))),
    )
    rows = rows.withColumn("_clean", F.when(F.col("_places").isNull(), text).otherwise(clean))
    return rows.select(*[F.col("_clean").alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])
