"""Human answers as a table: (subject, action, value, fields).

``action`` is ``value`` for a plain answer and ``edit`` for a correction, whose
new field values sit in ``fields``.  Rule-level answers (about a column, a value
list, a field, a batch) are few by nature and may be read on the driver, behind
a size check; answers about records never are.
"""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from loomfold.functions.text import column_key, pair_subject, subject_parts
from loomfold.spec import IGNORE_ANSWER

SCHEMA = "subject string, action string, value string, fields map<string,string>"
RULE_KINDS = ("map", "contest", "date", "enum", "field", "batch", "identity-batch")
RECORD_KINDS = ("record", "push", "identity", "rehire", "manager", "cycle", "cycle-clear")
MAX_RULE_ANSWERS = 100_000


def answers_frame(spark: SparkSession, answers: Mapping[str, Any] | None) -> DataFrame:
    rows = []
    for subject, answer in (answers or {}).items():
        if isinstance(answer, Mapping):
            fields = {str(k): str(v) for k, v in (answer.get("fields") or {}).items()}
            rows.append((subject, str(answer.get("action")), None, fields))
        else:
            rows.append((subject, "value", "true" if answer is True else str(answer), None))
    return spark.createDataFrame(rows, SCHEMA)


def kind_of(subject: Column) -> Column:
    return F.split(subject, ":", 2)[0]


def of_kind(answers: DataFrame, *kinds: str) -> DataFrame:
    return answers.where(kind_of(F.col("subject")).isin(*kinds))


def rule_answers(answers: DataFrame | None) -> dict[str, str]:
    """Rule-level answers on the driver; refuses a table that cannot be one."""
    if answers is None:
        return {}
    rows = of_kind(answers, *RULE_KINDS).where("action = 'value'").limit(MAX_RULE_ANSWERS + 1).collect()
    if len(rows) > MAX_RULE_ANSWERS:
        raise ValueError("more rule-level answers than any review could give")
    return {r["subject"]: r["value"] for r in rows}


def share_map_answers(answers: DataFrame, profiles: DataFrame) -> DataFrame:
    """(file, column, answer).  A column's own answer wins over one given for
    the same header in another file."""
    parts = subject_parts(F.col("subject"), 3)
    given = of_kind(answers, "map").select(parts(1).alias("file"), parts(2).alias("column"),
                                           F.col("value").alias("own"), F.col("subject"))
    shared = (given.groupBy(column_key(F.col("column")).alias("_key"))
              .agg(F.min_by("own", "subject").alias("shared")))
    return (profiles.select("file", "column", column_key(F.col("column")).alias("_key"))
            .join(given.select("file", "column", "own"), ["file", "column"], "left")
            .join(shared, "_key", "left")
            .select("file", "column", F.coalesce("own", "shared").alias("answer"))
            .where("answer IS NOT NULL"))


def memory_from_answers(answers: DataFrame) -> DataFrame:
    """The part of the answers that holds for any later export."""
    parts = subject_parts(F.col("subject"), 3)
    kind = kind_of(F.col("subject"))
    mapped = answers.where((kind == "map") & F.col("value").isNotNull()).select(
        "subject", column_key(parts(2)).alias("column_key"), F.col("value").alias("target"))
    contests = answers.where((kind == "contest") & F.col("value").isNotNull()).select(
        "subject", column_key(F.col("value")).alias("column_key"), parts(2).alias("target"))
    return mapped.unionByName(contests).where((F.col("column_key") != "") & (F.col("target") != IGNORE_ANSWER))


def update_memory(memory: DataFrame, answers: DataFrame, used_keys: DataFrame | None = None) -> DataFrame:
    """Fold new answers and this run's uses into (subject, column_key, target, times_used)."""
    new = memory_from_answers(answers).withColumnsRenamed({"column_key": "_k", "target": "_t"})
    merged = memory.join(new, "subject", "full_outer").select(
        "subject", F.coalesce("_k", "column_key").alias("column_key"), F.coalesce("_t", "target").alias("target"),
        F.coalesce("times_used", F.lit(0)).cast("long").alias("times_used"))
    if used_keys is None:
        return merged
    uses = used_keys.groupBy("column_key").agg(F.count(F.lit(1)).alias("_uses"))
    return merged.join(uses, "column_key", "left").select(
        "subject", "column_key", "target", (F.col("times_used") + F.coalesce("_uses", F.lit(0))).alias("times_used"))


def remembered(memory: DataFrame, profiles: DataFrame) -> DataFrame:
    """(file, column, remembered target); later subjects win where two disagree."""
    latest = memory.groupBy("column_key").agg(F.max_by("target", "subject").alias("remembered"))
    return (profiles.select("file", "column", column_key(F.col("column")).alias("column_key"))
            .join(latest, "column_key").select("file", "column", "remembered"))


def add_missing(answers: DataFrame, extra: DataFrame) -> DataFrame:
    """Answers plus those of ``extra`` whose subject nobody answered."""
    return answers.unionByName(extra.join(answers.select("subject"), "subject", "left_anti").select(*answers.columns))


def expand_skip_all(answers: DataFrame, refs: DataFrame, subject: str, prefix: str) -> DataFrame:
    """A batch answer "skip" stands for one answer per record it names."""
    said = answers.where((F.col("subject") == subject) & (F.col("value") == "skip")).select("subject").distinct()     # at most one row
    extra = (refs.join(F.broadcast(said), "subject", "left_semi").select("ref").distinct()
             .select(F.concat(F.lit(prefix + ":"), F.col("ref")).alias("subject"), F.lit("value").alias("action"),
                     F.lit("skip").alias("value"), F.lit(None).cast("map<string,string>").alias("fields")))
    return add_missing(answers, extra)


def pair_answers(pairs: DataFrame, prefix: str, answer: Column) -> DataFrame:
    """Answer rows for (key_a, key_b) pairs."""
    return pairs.select(pair_subject(prefix, F.col("key_a"), F.col("key_b")).alias("subject"), F.lit("value").alias("action"),
                        answer.alias("value"), F.lit(None).cast("map<string,string>").alias("fields"))
