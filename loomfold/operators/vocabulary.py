"""Fixed vocabularies: decided once per distinct value.

Exact words and known aliases are literal lookups; only the distinct leftovers
are scored against the options of their field.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from loomfold.functions.similarity import wratio
from loomfold.lineage import spread
from loomfold.spec import BLANK_ANSWER, DEFAULT_POLICY, FieldSpec, Policy, SchemaSpec

SHOWN_OPTIONS = 4


def _word_map(field: FieldSpec) -> dict[str, str]:
    known = {alias: option for alias, option in field.aliases if option in field.enum}
    known.update({option.lower(): option for option in field.enum})
    return known


def known_word(field: FieldSpec, lowered: Column) -> Column:
    """The canonical word for an exact or alias match, else null (a literal map)."""
    known = _word_map(field)
    if not known:
        return F.lit(None).cast("string")
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in known.items() for x in kv]), lowered)


def _by_field(spec: SchemaSpec, build) -> Column:
    out = F.lit(None)
    for f in spec.fields:
        if f.type == "enum":
            out = F.when(F.col("field") == f.name, build(f)).otherwise(out)
    return out


def canonicalise(values: DataFrame, spec: SchemaSpec, policy: Policy = DEFAULT_POLICY) -> DataFrame:
    """F4/W6 for distinct (field, value) rows, ``value`` trimmed and lowered.

    Adds ``canonical`` (null where it must be asked), ``score``, ``best`` and
    ``ranked``, the four closest options.
    """
    known = values.withColumn("_known", _by_field(spec, lambda f: known_word(f, F.col("value"))).cast("string"))
    options = _by_field(spec, lambda f: F.array(*[F.lit(o) for o in f.enum])).cast("array<string>")
    left = known.where(F.col("_known").isNull() & (F.col("value") != ""))
    # scoring is far heavier than its input is large: as many tasks as the session has partitions
    scored = (spread(left, "field", "value").select("field", "value", F.posexplode(options).alias("pos", "option"))
              .withColumn("score", wratio(F.col("value"), F.lower("option"))))
    ranked = F.sort_array(F.collect_list(F.struct("score", (-F.col("pos")).alias("order"), "option")), asc=False)
    best = (scored.groupBy("field", "value").agg(ranked.alias("_r"))
            .select("field", "value", F.col("_r")[0]["option"].alias("best"), F.col("_r")[0]["score"].alias("score"),
                    F.transform(F.slice("_r", 1, SHOWN_OPTIONS), lambda s: F.struct(s["option"].alias("option"), s["score"].alias("score"))).alias("ranked")))
    fuzzy = best.withColumn("canonical", F.when(F.col("score") >= policy.enum_auto_min, F.col("best")))
    empty = F.array().cast("array<struct<option:string,score:double>>")
    settled = known.where(F.col("_known").isNotNull()).select(
        "field", "value", F.col("_known").alias("best"), F.lit(100.0).alias("score"), empty.alias("ranked"),
        F.col("_known").alias("canonical"))
    return settled.unionByName(fuzzy).select("field", "value", "canonical", "score", "best", "ranked")


def vocabulary_fit(fit: DataFrame, policy: Policy = DEFAULT_POLICY) -> DataFrame:
    """A6 over distinct (file, column, field, value, canonical, provenance)."""
    unmatched = F.count(F.when(F.col("canonical").isNull(), F.lit(1)))
    counted = fit.groupBy("file", "column", "field", "provenance").agg(
        F.count(F.lit(1)).alias("total_values"), unmatched.alias("unmatched"))
    contradicted = ((F.col("provenance") != "human") & (F.col("total_values") >= policy.enum_mismatch_min_values)
                    & (F.col("unmatched") / F.col("total_values") >= policy.enum_mismatch_share))
    return counted.withColumn("matched", F.col("total_values") - F.col("unmatched")).withColumn("contradicted", contradicted)


def unknown_values(fit: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Values still to be asked, per (field, value), with the rows they touch.

    Values of a contradicted column are covered by the question about the column.
    The column shown is the first one that holds the value.
    """
    open_ = (fit.where("canonical IS NULL")
             .join(verdicts.where("contradicted").select("file", "column", "field"), ["file", "column", "field"], "left_anti"))
    return open_.groupBy("field", "value").agg(
        F.sum("n").alias("affected_rows"), F.max("score").alias("best_score"), F.min_by("best", "min_ord").alias("best"),
        F.min_by("ranked", "min_ord").alias("ranked"), F.min_by(F.struct("file", "column"), "min_ord").alias("at"))


def answered_word(field: str, lowered: Column, answers: dict[str, str]) -> Column:
    """A person's answer for this value ("" to leave it empty), else null."""
    prefix = f"enum:{field}:"
    words = {s[len(prefix):]: ("" if a == BLANK_ANSWER else a) for s, a in answers.items() if s.startswith(prefix)}
    if not words:
        return F.lit(None).cast("string")
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in words.items() for x in kv]), lowered)
