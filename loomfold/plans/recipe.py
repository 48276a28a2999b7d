"""Recipes: the rules a run settled on, as one table, and their replay.

Rows: (section, subject, file, column, from, to, how, evidence, n).  Answers about
rules and answers about single records are kept apart, because the second kind
carries personal data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from loomfold.functions.text import subject_parts
from loomfold.operators.answers import RECORD_KINDS, RULE_KINDS, kind_of
from loomfold.spec import BLANK_ANSWER, SchemaSpec

VERSION = 1
COLUMNS = ("section", "subject", "file", "column", "from", "to", "how", "evidence", "n")


def _rows(df: DataFrame, section: str, **cols) -> DataFrame:
    null = F.lit(None).cast("string")
    return df.select(F.lit(section).alias("section"), *[cols.get(c, null).cast("string").alias(c) for c in COLUMNS[1:-1]],
                     cols.get("n", F.lit(None)).cast("long").alias("n"))


def mapping_rules(mappings: DataFrame) -> DataFrame:
    how = (F.when(F.col("provenance").isin("human", "memory"), "confirmed").when(F.col("disposition") == "flagged", "inferred").otherwise("automatic"))
    reached = mappings.where("target_field IS NOT NULL")
    return _rows(reached, "field_mapping", file=F.col("file"), column=F.col("column"), **{"from": F.col("column")}, to=F.col("target_field"),
                 how=how, evidence=F.col("transform")).unionByName(
        _rows(mappings.where("target_field IS NULL"), "ignored_column", file=F.col("file"), column=F.col("column"), evidence=F.col("reason")))


def date_rules(audit: DataFrame) -> DataFrame:
    parts = subject_parts(F.col("entity"), 3)
    dates = audit.where(F.col("action").isin("infer_date_convention", "set_date_convention") & F.col("entity").startswith("column:"))
    return _rows(dates, "date_convention", file=parts(1), column=parts(2), to=F.col("after"), evidence=F.col("rationale"),
                 how=F.when(F.col("action") == "set_date_convention", "confirmed").otherwise("inferred"))


def value_rules(edits: DataFrame, answers: DataFrame | None = None) -> DataFrame:
    """Distinct (source word, vocabulary word) with the rows each touched; a
    person's answer for the same pair replaces what was scored.

    ``edits``: (before, after) plus optional order column ``entity``.
    """
    lowered = F.lower("before")
    agent = (edits.where("before IS NOT NULL AND after IS NOT NULL").groupBy(lowered.alias("_low"), "after")
             .agg(F.min_by("before", "entity").alias("before"), F.count(F.lit(1)).alias("n"))
             .withColumn("how", F.lit("automatic")))
    if answers is not None:
        parts = subject_parts(F.col("subject"), 3)
        human = (answers.where((kind_of(F.col("subject")) == "enum") & (F.col("action") == "value") & parts(2).isNotNull())
                 .select(F.lower(parts(2)).alias("_low"), F.col("value").alias("after"), parts(2).alias("before"), F.lit(0).cast("long").alias("n"),
                         F.lit("confirmed").alias("how"), "subject"))
        agent = agent.join(human.select("_low", "after"), ["_low", "after"], "left_anti").withColumn("subject", F.lit(None).cast("string")).unionByName(human)
    else:
        agent = agent.withColumn("subject", F.lit(None).cast("string"))
    to = F.when(F.col("after") == BLANK_ANSWER, "(blank)").otherwise(F.col("after"))
    return _rows(agent, "value_mapping", subject=F.col("subject"), **{"from": F.col("before")}, to=to, how=F.col("how"), n=F.col("n"))


def identity_rules(answers: DataFrame) -> DataFrame:
    s = F.col("value")
    meaning = (F.when((s == "merge") | s.startswith("merge:"), "one person on two rows: combine").when(s == "separate", "two records: keep both").otherwise(s))
    pairs = answers.where(kind_of(F.col("subject")).isin("identity", "rehire"))
    return _rows(pairs, "identity_rule", subject=F.col("subject"), **{"from": subject_parts(F.col("subject"), 2)(1)}, to=s, how=F.lit("confirmed"), evidence=meaning)


def answer_rows(answers: DataFrame) -> DataFrame:
    """The part that replays: rule subjects and record subjects in separate sections."""
    kind = kind_of(F.col("subject"))
    body = F.when(F.col("action") == "value", F.col("value")).otherwise(F.to_json("fields"))
    rule = _rows(answers.where(kind.isin(*RULE_KINDS)), "answers", subject=F.col("subject"), to=body, how=F.col("action"))
    return rule.unionByName(_rows(answers.where(kind.isin(*RECORD_KINDS)), "record_answers", subject=F.col("subject"), to=body, how=F.col("action")))


def build_recipe(mappings: DataFrame, audit: DataFrame, answers: DataFrame, spec: SchemaSpec, run_id: str) -> DataFrame:
    """Every rule of a run, read from the whole audit trail."""
    words = audit.where("action = 'canonicalise_value'")
    parts = [mapping_rules(mappings), date_rules(audit), value_rules(words, answers), identity_rules(answers), answer_rows(answers)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumns({"recipe_version": F.lit(VERSION), "source_run": F.lit(run_id), "entity": F.lit(spec.entity), "schema_version": F.lit(spec.version)})


def replay_recipe(recipe: DataFrame, given: DataFrame | None = None, with_records: bool = False) -> DataFrame:
    """Only answers come back; mappings and conventions are derived afresh.

    Raises before any job if the table is not a recipe; unsupported versions are refused.
    """
    missing = [c for c in (*COLUMNS, "recipe_version") if c not in recipe.columns]
    if missing:
        raise ValueError(f"not a recipe: missing {', '.join(missing)}")
    if recipe.schema["recipe_version"].dataType.simpleString() not in ("int", "bigint"):
        raise ValueError("recipe_version must be a number")
    wrong = recipe.where(F.col("recipe_version").isNotNull() & (F.col("recipe_version") != VERSION)).select("recipe_version").limit(1).collect()
    if wrong:
        raise ValueError(f"unsupported recipe_version {wrong[0][0]!r}; this build reads version {VERSION}")
    sections = ("answers", "record_answers") if with_records else ("answers",)
    rows = recipe.where(F.col("section").isin(*sections)).select(
        "subject", F.col("how").alias("action"), F.when(F.col("how") == "value", F.col("to")).alias("value"),
        F.when(F.col("how") != "value", F.from_json("to", "map<string,string>")).alias("fields"))
    if given is None:
        return rows
    return given.unionByName(rows.join(given.select("subject"), "subject", "left_anti").select(*given.columns))
