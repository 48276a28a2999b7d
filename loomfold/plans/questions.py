"""The question catalogue: each kind is a select over its operator's output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from loomfold.functions.text import col, filled, mask
from loomfold.operators.judge import question
from loomfold.operators.validate import faulty_fields, masked_record
from loomfold.spec import BLANK_ANSWER, DEFAULT_POLICY, ESCALATED, IGNORE_ANSWER, Policy, SchemaSpec

def _const(*values: str) -> Column:
    return F.array(*[F.lit(v) for v in values])


def mapping_questions(mappings: DataFrame, profiles: DataFrame, policy: Policy = DEFAULT_POLICY) -> DataFrame:
    """Q1: columns no rule settled, with the fields worth offering."""
    open_ = mappings.where((F.col("disposition") == ESCALATED) & F.col("contest").isNull()).join(
        profiles.select("file", "column", "inferred_type", "samples", "null_rate", "cardinality"), ["file", "column"])
    fields = F.transform(F.filter("candidates", lambda c: c["score"] >= policy.mapping_ignore_max), lambda c: c["field"])
    plausible = F.when(F.size(fields) > 0, fields).otherwise(F.transform(F.slice("candidates", 1, 1), lambda c: c["field"]))
    return question(open_, "column_mapping", F.concat(F.lit("map:"), "file", F.lit(":"), "column"), F.concat(F.lit("Which field is '"), "column", F.lit("'?")),
                    F.concat(plausible, _const(IGNORE_ANSWER)),
                    {"inferred_type": F.col("inferred_type"), "samples": F.array_join("samples", ", "), "null_rate": F.round("null_rate", 2),
                     "distinct": F.col("cardinality"), "why": F.col("reason"), "scores": F.to_json("candidates")},
                    file=F.col("file"), column=F.col("column"))


def contest_questions(mappings: DataFrame) -> DataFrame:
    """Q2: one field, several columns with an equal claim (best first)."""
    ranked = F.sort_array(F.collect_list(F.struct("confidence", (-F.col("column_pos")).alias("p"), "column")), asc=False)
    groups = mappings.where("contest IS NOT NULL").groupBy("file", "contest").agg(F.transform(ranked, lambda s: s["column"]).alias("columns"))
    return question(groups, "column_mapping", F.concat(F.lit("contest:"), "file", F.lit(":"), "contest"),
                    F.concat(F.lit("Which column is '"), "contest", F.lit("'?")), F.col("columns"), {"contest": F.lit(True)},
                    field=F.col("contest"), file=F.col("file"))


def vocabulary_questions(verdicts: DataFrame) -> DataFrame:
    """Q3: the values argue against the mapping."""
    bad = verdicts.where("contradicted")
    return question(bad, "column_mapping", F.concat(F.lit("map:"), "file", F.lit(":"), "column"),
                    F.concat(F.lit("'"), "column", F.lit("' holds values that are not "), "field", F.lit(" values")),
                    F.array(F.lit(IGNORE_ANSWER), F.col("field")),
                    {"unmatched": F.col("unmatched"), "total_values": F.col("total_values"), "vocabulary_mismatch": F.lit(True)},
                    field=F.col("field"), file=F.col("file"), column=F.col("column"))


def date_questions(conventions: DataFrame) -> DataFrame:
    """Q4: nothing in the column fixes the order of day and month."""
    ask = conventions.where("outcome = 'ask'")
    return question(ask, "date_convention", F.concat(F.lit("date:"), "file", F.lit(":"), "column"),
                    F.concat(F.lit("Is '"), "column", F.lit("' day first or month first?")), _const("DMY", "MDY"),
                    {"ambiguous": F.col("ambiguous"), "total": F.col("total"), "anchors": F.col("anchors")},
                    F.col("ambiguous"), F.col("field"), F.col("file"), F.col("column"))


def enum_questions(unknown: DataFrame) -> DataFrame:
    """Q5: one question per unknown word, with the closest options."""
    return question(unknown, "enum_value", F.concat(F.lit("enum:"), "field", F.lit(":"), "value"), F.concat(F.lit("What does '"), "value", F.lit("' mean?")),
                    F.concat(F.transform("ranked", lambda r: r["option"]), _const(BLANK_ANSWER)),
                    {"best": F.col("best"), "best_score": F.round("best_score", 1), "affected_rows": F.col("affected_rows")},
                    F.col("affected_rows"), F.col("field"), F.col("at.file"), F.col("at.column"))


def rehire_questions(found: DataFrame) -> DataFrame:
    """Q6: one person identifier under several codes."""
    return question(found, "rehire_suspected", F.col("subject"), F.lit("Rehire or duplicate?"),
                    F.array(F.lit("separate"), F.concat(F.lit("merge:"), "later_key"), F.concat(F.lit("merge:"), "earlier_key")),
                    {"person": mask(F.upper("person")), "records": F.col("n_records"), "codes": F.col("n_codes")}, F.col("n_records"))


def duplicate_questions(pairs: DataFrame) -> DataFrame:
    """Q7: same birthday, same first name, related surname."""
    a = F.when(F.col("seq_a") <= F.col("seq_b"), F.col("key_a")).otherwise(F.col("key_b"))
    b = F.when(F.col("seq_a") <= F.col("seq_b"), F.col("key_b")).otherwise(F.col("key_a"))
    return question(pairs, "duplicate_suspected", F.col("subject"), F.lit("Are these the same person?"),
                    F.array(F.lit("separate"), F.concat(F.lit("merge:"), a), F.concat(F.lit("merge:"), b)),
                    {"date_of_birth": F.col("dob"), "similarity": F.round("similarity", 1)}, F.lit(2))


def flood_questions(flood: DataFrame) -> DataFrame:
    """Q8: two files describing the same people are one question."""
    return question(flood.where("flood"), "batch_anomaly", F.col("subject"), F.concat("file_a", F.lit(" and "), "file_b", F.lit(" look like two exports of the same records")),
                    _const("merge_all", "separate_all", "review"), {"pairs": F.col("n_pairs"), "rows_a": F.col("rows_a"), "rows_b": F.col("rows_b")}, F.col("n_pairs"))


def record_questions(validated: DataFrame, spec: SchemaSpec, held=()) -> DataFrame:
    """Q9: records still failing after the repair."""
    bad = validated.where((F.size("issues") > 0) & (F.col("push_status") != "skipped"))
    return question(bad, "validation_failed", F.concat(F.lit("record:"), "key"), F.concat("key", F.lit(" cannot be loaded")), _const("edit", "skip"),
                    {"issues": F.array_join(F.transform("issues", lambda i: i["message"]), "; "), "editable": F.array_join(faulty_fields(spec, held), ","),
                     "record": masked_record(spec)}, F.lit(1))


def field_questions(missing: DataFrame, asked: list[str]) -> DataFrame:
    """Q10: a required field nothing feeds."""
    rows = missing.where(F.col("field").isin(*asked)) if asked else missing.limit(0)
    return question(rows, "field_unsourced", F.concat(F.lit("field:"), "field"), F.concat(F.lit("Nothing in these files provides "), "field"),
                    _const("not_required", "skip_records", "remap"), {"missing": F.col("missing"), "total": F.col("total")}, F.col("missing"), F.col("field"))


def orphan_questions(orphans: DataFrame) -> DataFrame:
    """Q11: a reference to nobody, asked once per missing value."""
    return question(orphans, "hierarchy_orphan", F.concat(F.lit("manager:"), "missing"), F.concat(F.lit("Nobody has the address "), "missing"),
                    _const("clear", "edit"), {"reports": F.col("n_reports")}, F.col("n_reports"))


def cycle_questions(cycles: DataFrame) -> DataFrame:
    """Q12: a loop of references, cut at one of its members."""
    return question(cycles, "hierarchy_cycle", F.col("subject"), F.lit("These records report to each other"),
                    F.transform("keys", lambda k: F.concat(F.lit("cycle-clear:"), k)), {"members": F.col("n_members")}, F.col("n_members"))


def rejection_questions(outcomes: DataFrame, code: str = "employee_code") -> DataFrame:
    """Q13: a refusal no retry can change."""
    bad = outcomes.where("outcome = 'rejected'")
    return question(bad, "push_rejected", F.concat(F.lit("push:"), "key"), F.concat(F.lit("The target refused "), "code"), _const("skip", "edit"),
                    {"status": F.col("status"), "message": F.col("message"), "editable": F.lit(code)}, F.lit(1))


def rejection_flood_question(flood: DataFrame) -> DataFrame:
    """Q14: most of a batch refused for one reason."""
    return question(flood.where("flood"), "batch_anomaly", F.lit("batch:push_rejected"), F.lit("Most of the batch was refused for one reason"),
                    _const("skip", "review"), {"rejected": F.col("rejected"), "attempted": F.col("attempted"), "message": F.col("reason")}, F.col("rejected"))


def after_push(outcomes: DataFrame, flood: DataFrame) -> DataFrame:
    """Q13 or, where the rejections are one fact, Q14 alone."""
    is_flood = flood.where("flood").select(F.lit("push_rejected").alias("type"))
    return rejection_questions(outcomes).join(is_flood, "type", "left_anti").unionByName(rejection_flood_question(flood))


def coverage_question(coverage: DataFrame) -> DataFrame:
    """Q15: the files are about something else."""
    return question(coverage.where("stop"), "batch_anomaly", F.lit("batch:coverage"), F.lit("These files do not look like the expected entity"),
                    _const("abort", "continue"), {k: F.col(k) for k in ("mapped", "columns", "required_found", "required_total")})


def rate_question(batch: DataFrame) -> DataFrame:
    """Q16: too much of the batch needs a person."""
    return question(batch.where("tripped IS NOT NULL"), "batch_anomaly", F.lit("batch:rate"), F.lit("Too much of this run needs a person"),
                    _const("abort", "continue"), {k: F.col(k) for k in ("blocked", "records", "questions", "tripped")})


def name_of(first: str = "first_name", last: str = "last_name") -> Column:
    return F.trim(F.concat_ws(" ", *[F.when(filled(col(n)), col(n)) for n in (first, last)]))
