"""Applying accepted mappings: one narrow projection per source.

Every rule is settled before a row is touched -- date conventions from column
votes, words from distinct values -- so the row pass is generated expressions
with the decisions folded in as literals.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field as dc_field
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from loomfold.functions.dates import apply_convention, describe, with_readings
from loomfold.functions.text import col, collapse, filled, normalise, smart_title, split_name, strip
from loomfold.lineage import broadcast_if_small, cut
from loomfold.operators.dates import column_votes, decide_conventions
from loomfold.operators.match import SPLIT
from loomfold.operators.profile import union_all
from loomfold.operators.vocabulary import answered_word, canonicalise, known_word, unknown_values, vocabulary_fit
from loomfold.spec import AUTO, DEFAULT_POLICY, FLAGGED, Policy, SchemaSpec

FILE_SHIFT = 44                      # _ord = file number << 44 | row number


@dataclass
class CleanResult:
    rows: DataFrame                  # field columns, _source, _file, _ord, _waiting, _questions, _issues, _edits
    conventions: DataFrame           # one row per date column
    verdicts: DataFrame              # one row per vocabulary column
    unknown: DataFrame               # one row per value to ask about
    blocked: dict[str, set[str]] = dc_field(default_factory=dict)


def accepted(mappings: Sequence) -> list:
    """Only applied or flagged mappings feed a field."""
    return [m for m in mappings if m["target_field"] and m["disposition"] in (AUTO, FLAGGED)]


def _by_file(mappings: Sequence) -> dict[str, list]:
    out: dict[str, list] = {}
    for m in accepted(mappings):
        out.setdefault(m["file"], []).append(m)
    return out


def _columns_of(vf: DataFrame, wanted: Sequence[tuple[str, str]]) -> DataFrame:
    """The frequencies of some columns; the list is catalog-sized and literal."""
    hit = reduce(lambda a, b: a | b, [(F.col("file") == f) & (F.col("column") == c) for f, c in wanted], F.lit(False))
    return vf.where(hit)


def _field_case(pairs: Sequence[tuple[str, str, str]]) -> Column:
    out = F.lit(None).cast("string")
    for file, column, value in pairs:
        out = F.when((F.col("file") == file) & (F.col("column") == column), F.lit(value)).otherwise(out)
    return out


def date_conventions(vf: DataFrame, mappings: Sequence, spec: SchemaSpec, policy: Policy, answers: Mapping[str, str]) -> DataFrame:
    cols = [(m["file"], m["column"]) for m in accepted(mappings) if spec.field(m["target_field"]).type == "date"]
    fields = [(m["file"], m["column"], m["target_field"]) for m in accepted(mappings)]
    return decide_conventions(column_votes(_columns_of(vf, cols)), policy, answers).withColumn("field", _field_case(fields))


def vocabulary_values(vf: DataFrame, mappings: Sequence, spec: SchemaSpec, policy: Policy, answers: Mapping[str, str]) -> DataFrame:
    """Distinct values of vocabulary columns nobody has answered, canonicalised.

    (file, column, field, provenance, value, n, min_ord, canonical, score, best, ranked)
    """
    maps = [m for m in accepted(mappings) if spec.field(m["target_field"]).type == "enum"]
    fields = [(m["file"], m["column"], m["target_field"]) for m in maps]
    origin = [(m["file"], m["column"], m["provenance"]) for m in maps]
    seen = (_columns_of(vf, [(f, c) for f, c, _ in fields])
            .withColumns({"field": _field_case(fields), "provenance": _field_case(origin), "value": F.lower(collapse(F.col("value")))})
            .where("value <> ''"))
    given = [s.split(":", 1)[1] for s in answers if s.startswith("enum:")]
    if given:
        seen = seen.where(~F.concat("field", F.lit(":"), "value").isin(*given))
    values = seen.groupBy("file", "column", "field", "provenance", "value").agg(F.sum("n").alias("n"), F.min("min_pos").alias("min_ord"))
    words = canonicalise(values.select("field", "value").distinct(), spec, policy)
    return values.join(words, ["field", "value"])


def cosmetic_changes(vf: DataFrame, mappings: Sequence, spec: SchemaSpec) -> DataFrame:
    """Per column, how many cells differ from their cleaned form -- counted on
    distinct values, without another pass over the rows."""
    value, clean = F.col("value"), F.lit(None).cast("string")
    by_target: dict[str, list[tuple[str, str]]] = {}
    for m in accepted(mappings):
        if m["transform"] != SPLIT:
            by_target.setdefault(m["target_field"], []).append((m["file"], m["column"]))
    for target, places in by_target.items():
        here = reduce(lambda a, b: a | b, [(F.col("file") == f) & (F.col("column") == c) for f, c in places])
        clean = F.when(here, normalise(value, spec.field(target))).otherwise(clean)
    return (vf.withColumn("_clean", clean).where((value != "") & (F.col("_clean") != "") & (F.col("_clean") != value))
            .groupBy("file", "column").agg(F.sum("n").alias("changed")))


def name_order(df: DataFrame, column: str) -> DataFrame:
    """How a full-name column is written, judged on all its values."""
    first = df.select(col(column).alias("v")).where(strip(F.col("v")) != "")
    n, commas = F.count(F.lit(1)), F.count(F.when(F.contains("v", F.lit(",")), 1))
    long = F.count(F.when(F.size(F.split(collapse(F.col("v")), " ")) > 2, 1))
    counted = first.agg(n.alias("sampled"), commas.alias("with_comma"), long.alias("long_names")).where("sampled > 0")
    surname_first = F.col("with_comma") >= F.col("sampled") * 0.5
    return counted.withColumn("order", F.when(surname_first, "surname first").otherwise("given name first")).withColumn(
        "disposition", F.when(surname_first, AUTO).otherwise(FLAGGED))


OPEN = ("_waiting", "_questions", "_issues", "_edits")


def cleaned_rows(df: DataFrame, carry: Sequence[Column | str], maps: Sequence[Mapping], spec: SchemaSpec, conventions: Mapping[tuple[str, str], str | None],
                 asking: set[tuple[str, str]], contradicted: set[tuple[str, str]], fuzzy: Mapping[str, DataFrame], answers: Mapping[str, str]) -> DataFrame:
    """``carry``, the contract's fields and what is open about each row (OPEN), by decided rules.

    Row by row, with one lookup of decided words per vocabulary column: batch and stream alike.
    """
    # stage 1: normalised text (and date readings), each computed once per row
    stage: dict[str, Column] = {}
    readings: dict[str, Column] = {}
    for i, m in enumerate(maps):
        target = spec.field(m["target_field"])
        if m["transform"] == SPLIT:
            stage[f"_n{i}"] = split_name(col(m["column"]))
            continue
        stage[f"_n{i}"] = normalise(col(m["column"]), target)
        if target.type == "date":
            readings[f"_d{i}"] = F.col(f"_n{i}")
    kept = df.select(*carry)
    rows = df.select(*carry, *[c.alias(n) for n, c in stage.items()])
    rows = with_readings(rows, readings)
    for i, m in enumerate(maps):
        words = fuzzy.get(m["target_field"])
        if words is not None and m["transform"] != SPLIT:
            rows = rows.join(words.select(F.col("value").alias(f"_w{i}"), F.col("canonical").alias(f"_f{i}")),
                             F.lower(f"_n{i}") == F.col(f"_w{i}"), "left").drop(f"_w{i}")

    # stage 2: fields, and what is open or changed about this row
    out: dict[str, Column] = {}
    waiting, questions, issues, edits = [], [], [], []
    for i, m in enumerate(maps):
        target, raw, at = spec.field(m["target_field"]), F.col(f"_n{i}"), (m["file"], m["column"])
        if m["transform"] == SPLIT:
            out["first_name"], out["last_name"] = smart_title(raw["first"]), smart_title(raw["last"])
        elif target.type == "date":
            read = apply_convention(F.col(f"_d{i}"), conventions.get(at))
            out[target.name] = F.coalesce(read["date"].cast("string"), F.lit(""))
            issues.append(F.when((raw != "") & read["date"].isNull(), F.concat(F.lit(f"{target.name}: "), read["error"], F.lit(" ("), raw, F.lit(")"))))
            if at in asking:
                open_ = F.col(f"_d{i}")["ambiguous"]
                waiting.append(F.when(open_, F.lit(target.name)))
                questions.append(F.when(open_, F.lit(f"date:{at[0]}:{at[1]}")))
        elif target.type == "enum":
            lowered = F.lower(raw)
            given = answered_word(target.name, lowered, answers)
            word = F.coalesce(known_word(target, lowered), F.col(f"_f{i}") if target.name in fuzzy else F.lit(None).cast("string"))
            out[target.name] = F.coalesce(given, word, F.lit(""))
            changed = given.isNull() & word.isNotNull() & (F.lower(word) != lowered)
            edits.append(F.when(changed, F.struct(F.lit(target.name).alias("field"), raw.alias("before"), word.alias("after"))))
            if at not in contradicted:
                open_ = (raw != "") & given.isNull() & word.isNull()
                waiting.append(F.when(open_, F.lit(target.name)))
                questions.append(F.when(open_, F.concat(F.lit(f"enum:{target.name}:"), lowered)))
        else:
            out[target.name] = raw
    for f in spec.fields:
        value = out.get(f.name, F.lit(""))
        out[f.name] = F.when(filled(value), value).otherwise(F.lit(f.default)) if f.default is not None else value

    def packed(items: list[Column], kind: str) -> Column:
        return F.array_compact(F.array(*items)) if items else F.array().cast(kind)

    return rows.select(*[col(c) for c in kept.columns], *[out[n].alias(n) for n in spec.names],
                       packed(waiting, "array<string>").alias("_waiting"), packed(questions, "array<string>").alias("_questions"),
                       packed(issues, "array<string>").alias("_issues"),
                       packed(edits, "array<struct<field:string,before:string,after:string>>").alias("_edits"))


def clean(sources: Mapping[str, DataFrame], mappings: Sequence, spec: SchemaSpec, vf: DataFrame, policy: Policy = DEFAULT_POLICY,
          answers: Mapping[str, str] | None = None) -> CleanResult:
    """P1/P2, F1-F12 applied.  ``mappings`` are the (catalog-sized) mapping rows,
    ``answers`` the rule-level answers."""
    answers = dict(answers or {})
    index = _by_file(mappings)
    conventions = cut(date_conventions(vf, mappings, spec, policy, answers))
    fit = cut(vocabulary_values(vf, mappings, spec, policy, answers))
    verdicts = cut(vocabulary_fit(fit, policy))
    settled = {(r["file"], r["column"]): r for r in conventions.collect()}            # one row per date column
    refused = {(r["file"], r["column"]) for r in verdicts.where("contradicted").collect()}
    asking = {at for at, r in settled.items() if r["outcome"] == "ask"}
    hits = fit.where("canonical IS NOT NULL AND score < 100").select("field", "value", "canonical").distinct()
    in_use = [r["field"] for r in hits.select("field").distinct().collect()]
    fuzzy = {name: broadcast_if_small(hits.where(F.col("field") == name).select("value", "canonical"), policy.broadcast_rows) for name in in_use}

    ordered = lambda number: (F.lit(number << FILE_SHIFT) + F.col("_pos")).alias("_ord")        # noqa: E731
    parts = [cleaned_rows(df, ["_source", "_file", ordered(number)], index[file], spec, {at: r["applied"] for at, r in settled.items()}, asking, refused, fuzzy, answers)
             for number, (file, df) in enumerate(sources.items()) if file in index]
    if not parts:
        raise ValueError("no column of any source reached the contract")
    blocked: dict[str, set[str]] = {}
    for m in accepted(mappings):
        if (m["file"], m["column"]) in asking | refused:
            blocked.setdefault(m["file"], set()).add(m["target_field"])
    return CleanResult(union_all(parts), conventions, verdicts, unknown_values(fit, verdicts), blocked)


def canonical_edits(rows: DataFrame) -> DataFrame:
    """One row per value rewritten to a vocabulary word: (_source, field, before, after)."""
    return rows.select("_source", F.inline("_edits"))


def convention_audit(conventions: DataFrame) -> DataFrame:
    """Audit rows for the columns whose convention was confirmed or inferred."""
    named = F.when(F.col("applied") == "DMY", describe("DMY")).when(F.col("applied") == "MDY", describe("MDY")).otherwise(describe("ISO"))
    return conventions.where(F.col("outcome").isin("confirmed", "inferred")).select(
        F.when(F.col("outcome") == "confirmed", "human").otherwise("agent").alias("actor"),
        F.when(F.col("outcome") == "confirmed", "set_date_convention").otherwise("infer_date_convention").alias("action"),
        F.concat(F.lit("column:"), "file", F.lit(":"), "column").alias("entity"), F.lit("ambiguous").alias("before"), named.alias("after"),
        F.when(F.col("outcome") == "confirmed", AUTO).otherwise(FLAGGED).alias("disposition"),
        F.format_string("%d of %d values fix the order and %.0f%% of them agree", "anchors", "total", F.col("agreement") * 100).alias("rationale"))
