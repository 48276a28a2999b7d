"""Views a reviewer filters and counts: audit, mappings, plan and records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from loomfold.functions.text import col
from loomfold.spec import SchemaSpec

AUDIT_COLUMNS = ("at", "actor", "action", "entity", "before", "after", "rationale")


def contains_text(query: str | None, *parts: Column) -> Column:
    """Case-blind search in the parts joined by spaces; no query matches everything."""
    if not query:
        return F.lit(True)
    blanks = [F.coalesce(p.cast("string"), F.lit("")) for p in parts]
    return F.contains(F.lower(F.concat_ws(" ", *blanks)), F.lit(query.lower()))


def search_audit(audit: DataFrame, actor: str = "all", query: str | None = None) -> DataFrame:
    """By actor, and free text over entity, action and reason."""
    who = F.lit(True) if actor == "all" else F.col("actor") == actor
    return audit.where(who & contains_text(query, F.col("entity"), F.col("action"), F.col("rationale")))


def actor_counts(audit: DataFrame) -> DataFrame:
    return audit.groupBy("actor").agg(F.count(F.lit(1)).alias("n"))


def agent_actions(audit: DataFrame) -> DataFrame:
    """What was done unasked, by action; order by ``n`` for the largest first."""
    return audit.where("actor = 'agent'").groupBy("action").agg(F.count(F.lit(1)).alias("n"))


def audit_listing(audit: DataFrame, limit: int = 1000) -> DataFrame:
    """A page for a person; plans and recipes read the whole trail instead."""
    return audit.orderBy("at", "id").limit(limit)


def write_audit_csv(audit: DataFrame, path: str) -> None:
    audit.select(*AUDIT_COLUMNS).write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def unreached_fields(mappings: DataFrame, spec: SchemaSpec) -> DataFrame:
    """Contract fields no column reached."""
    fields = spec.fields_table(mappings.sparkSession)
    hit = mappings.where("target_field IS NOT NULL").select(F.col("target_field").alias("name")).distinct()
    return fields.join(hit, "name", "left_anti").select("field_pos", "name", "required")


def search_mappings(mappings: DataFrame, disposition: str = "all", query: str | None = None) -> DataFrame:
    by = F.lit(True) if disposition == "all" else F.col("disposition") == disposition
    return mappings.where(by & contains_text(query, F.col("column"), F.col("target_field"), F.col("reason")))


def search_plan(plan: DataFrame, bucket: str, query: str | None = None, code: str = "employee_code") -> DataFrame:
    return plan.where((F.col("bucket") == bucket) & contains_text(query, F.col("key"), F.col("name"), col(code)))


def search_records(records: DataFrame, spec: SchemaSpec, status: str = "all", query: str | None = None) -> DataFrame:
    by = F.lit(True) if status == "all" else F.col("push_status") == status
    return records.where(by & contains_text(query, F.col("key"), *[col(n) for n in spec.names]))
