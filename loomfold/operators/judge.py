"""Questions: shaping them, linking them to records, and judging the whole batch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from loomfold.functions.text import column_key
from loomfold.spec import AUTO, DEFAULT_POLICY, FLAGGED, Policy, SchemaSpec

QUESTION = ("type string, subject string, title string, field string, file string, column string, n_affected long, "
            "evidence map<string,string>, options array<string>")
COLUMN_LEVEL = ("column_mapping", "date_convention", "enum_value", "field_unsourced")
RECORD_LEVEL = ("validation_failed", "duplicate_suspected", "rehire_suspected", "hierarchy_orphan", "hierarchy_cycle", "push_rejected")


def question(df: DataFrame, kind: str, subject: Column, title: Column, options: Column, evidence: dict[str, Column],
             n_affected: Column | None = None, field: Column | None = None, file: Column | None = None, column: Column | None = None) -> DataFrame:
    """Rows in the common question shape; evidence values become text."""
    null = F.lit(None).cast("string")
    pairs = [x for k, v in evidence.items() for x in (F.lit(k), v.cast("string"))]
    return df.select(
        F.lit(kind).alias("type"), subject.alias("subject"), title.alias("title"),
        (null if field is None else field).alias("field"), (null if file is None else file).alias("file"),
        (null if column is None else column).alias("column"),
        (F.lit(0) if n_affected is None else n_affected).cast("long").alias("n_affected"),
        F.create_map(*pairs).alias("evidence"), options.alias("options"))


def empty_questions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], QUESTION)


def one_per_column_name(questions: DataFrame, order: Sequence[str]) -> DataFrame:
    """The same header in several files is one question; ``also_in`` lists the rest.

    Contests are about a field, not a header, and stay as they are.
    """
    names = questions.columns
    plain = (F.col("type") == "column_mapping") & ~F.col("subject").startswith("contest:")
    rank = F.struct(*[F.col(c) for c in order])
    grouped = (questions.where(plain).groupBy(column_key(F.col("column")).alias("_key"))
               .agg(F.min_by(F.struct(*names), rank).alias("_q"), F.array_sort(F.collect_list(F.struct(rank.alias("r"), F.col("file").alias("f")))).alias("_all")))
    also = F.transform(F.slice("_all", F.lit(2), F.size("_all")), lambda s: s["f"])
    kept = grouped.select("_q.*", also.alias("also_in"))
    return kept.unionByName(questions.where(~plain).withColumn("also_in", F.array().cast("array<string>")))


def link_refs(refs: DataFrame, members: DataFrame, records: DataFrame) -> DataFrame:
    """(subject, ``_rid``) -- a reference is a source row, or else a record key."""
    by_row = refs.join(members.select(F.col("_source").alias("ref"), "_rid"), "ref").select("subject", "_rid")
    rest = refs.join(members.select(F.col("_source").alias("ref")), "ref", "left_anti")
    by_key = rest.join(records.select(F.col("key").alias("ref"), "_rid"), "ref").select("subject", "_rid")
    return by_row.unionByName(by_key).distinct()


def fields_under_question(links: DataFrame, questions: DataFrame) -> DataFrame:
    """Per record, the fields some open question already covers (at most the contract's)."""
    about = questions.where("field IS NOT NULL AND field <> ''").select("subject", "field")
    return links.join(about, "subject").groupBy("_rid").agg(F.array_sort(F.collect_set("field")).alias("waiting"))


def block_counts(links: DataFrame) -> DataFrame:
    """Per record, how many open questions it waits for."""
    return links.groupBy("_rid").agg(F.count_distinct("subject").alias("n_blocks"))


def mapping_coverage(mappings: DataFrame, spec: SchemaSpec, policy: Policy = DEFAULT_POLICY) -> DataFrame:
    """Share of columns mapped and of required fields sourced; ``stop`` if both are low."""
    applied = F.col("target_field").isNotNull() & F.col("disposition").isin(AUTO, FLAGGED)
    cols = mappings.agg(F.count(F.lit(1)).alias("columns"), F.count(F.when(applied, 1)).alias("mapped"))
    split = F.when(F.col("transform") == "split_full_name", F.array(F.lit("first_name"), F.lit("last_name"))).otherwise(F.array().cast("array<string>"))
    fed = mappings.select(F.explode(F.concat(split, F.when(applied, F.array("target_field")).otherwise(F.array().cast("array<string>")))).alias("f"))
    found = fed.where(F.col("f").isin(*spec.required)).agg(F.count_distinct("f").alias("required_found"))
    needed = len(spec.required)
    both = cols.withColumn("_k", F.lit(1)).join(found.withColumn("_k", F.lit(1)), "_k").drop("_k")
    coverage = F.when(F.col("columns") == 0, 0.0).otherwise(F.col("mapped") / F.col("columns"))
    required = F.lit(1.0) if needed == 0 else F.col("required_found") / needed
    return both.select("columns", "mapped", coverage.alias("coverage"), "required_found", F.lit(needed).alias("required_total"),
                       ((F.col("columns") > 0) & (coverage < policy.min_mapping_coverage) & (required < policy.min_required_found)).alias("stop"))


def breaker_trips(blocked: Column, total: Column, questions: Column, policy: Policy = DEFAULT_POLICY) -> Column:
    """A12 as an expression: null, "absolute" or "rate"."""
    rate = (total >= policy.breaker_min_records) & (questions >= policy.breaker_min_questions) & (blocked / total >= policy.breaker_rate)
    return F.when(questions >= policy.breaker_absolute, "absolute").when(rate, "rate")


def batch_rate(questions: DataFrame, refs: DataFrame, n_records: DataFrame, policy: Policy = DEFAULT_POLICY, more: int = 0, more_refs: DataFrame | None = None) -> DataFrame:
    """A12 over question and reference tables: one row with the counts and the verdict.

    ``more``/``more_refs``: record-level questions that are counted but not listed, and the records they hold.
    """
    record_level = questions.where(F.col("type").isin(*RECORD_LEVEL)).select("subject")
    held = refs.join(record_level, "subject", "left_semi").select("ref")
    held = held if more_refs is None else held.unionByName(more_refs.select("ref"))
    blocked = held.agg(F.count_distinct("ref").alias("blocked"))
    asked = questions.agg((F.count(F.lit(1)) + more).alias("questions"))
    k = lambda df: df.withColumn("_k", F.lit(1))           # noqa: E731
    one = k(blocked).join(k(asked), "_k").join(k(n_records.select(F.col("n").alias("records"))), "_k").drop("_k")
    return one.withColumn("tripped", breaker_trips(F.col("blocked"), F.col("records"), F.col("questions"), policy))


def question_counts(questions: DataFrame) -> DataFrame:
    """Open questions by type."""
    return questions.groupBy("type").agg(F.count(F.lit(1)).alias("n"))
