"""The plan: what will be sent, what is held back and why, what is settled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from loomfold.functions.text import col, filled
from loomfold.operators.load import payload
from loomfold.spec import SchemaSpec

SETTLED = ("success", "skipped", "rolled_back")
# Audit actions that changed a value inside a record.
VALUE_ACTIONS = ("canonicalise_value", "repair_value", "merge_duplicate", "normalise_values")


def bucket() -> Column:
    """P7."""
    free = (F.size("issues") == 0) & (F.col("n_blocks") == 0) & F.col("push_status").isin("pending", "failed")
    return F.when(F.col("push_status").isin(*SETTLED), "settled").when(free, "will_send").otherwise("held_back")


def reason_held() -> Column:
    status = F.col("push_status")
    shown = F.transform(F.slice("issues", 1, 3), lambda i: i["message"])
    return (F.when(status == "success", "loaded into the target").when(status == "rolled_back", "rolled back")
            .when(F.col("n_blocks") > 0, F.concat(F.lit("waiting on "), F.col("n_blocks").cast("string"), F.lit(" open question(s)")))
            .when(F.size("issues") > 0, F.array_join(shown, "; "))
            .when(status == "rejected", "refused by the target").when(status == "skipped", "skipped on purpose").otherwise(""))


def record_changes(audit: DataFrame, members: DataFrame, records: DataFrame) -> DataFrame:
    """(``_rid``, action, before, after, rationale): value-level edits of each record,
    found through any of its source rows or its key."""
    edits = audit.where(F.col("action").isin(*VALUE_ACTIONS) & (F.col("entity") != "") & ~F.col("entity").startswith("column:"))
    names = (members.select("_rid", F.col("_source").alias("entity"))
             .unionByName(records.select("_rid", F.col("key").alias("entity"))).distinct())
    return edits.join(names, "entity").select("_rid", "action", "before", "after", "rationale")


def field_origin(mappings: DataFrame) -> DataFrame:
    """The source columns feeding each field; two or more means the merge had to pick."""
    return (mappings.where("target_field IS NOT NULL").groupBy("target_field")
            .agg(F.array_sort(F.collect_list(F.concat("file", F.lit("."), "column"))).alias("origins"))
            .withColumn("multi_source", F.size("origins") > 1))


def build_plan(records: DataFrame, spec: SchemaSpec, changes: DataFrame | None = None) -> DataFrame:
    """Records with bucket, reason, payload and number of changes."""
    name = F.trim(F.concat_ws(" ", *[F.when(filled(col(n)), col(n)) for n in ("first_name", "last_name") if n in spec.names]))
    out = records.withColumns({"bucket": bucket(), "reason_held": reason_held(), "payload": payload(spec), "name": name,
                               "merged": F.col("n_sources") > 1})
    if changes is None:
        return out.withColumn("n_changes", F.lit(0).cast("long"))
    counted = changes.groupBy("_rid").agg(F.count(F.lit(1)).alias("n_changes"))
    return out.join(counted, "_rid", "left").fillna(0, ["n_changes"])


def plan_totals(plan: DataFrame) -> DataFrame:
    """A21."""
    b, n = F.col("bucket"), F.col("n_changes")
    moving = b.isin("will_send", "settled")
    return plan.agg(F.count(F.when(b == "will_send", 1)).alias("will_send"), F.count(F.when(b == "held_back", 1)).alias("held_back"),
                    F.count(F.when(b == "settled", 1)).alias("settled"),
                    F.coalesce(F.sum(F.when(moving, n)), F.lit(0)).alias("fields_changed"),
                    F.count(F.when(moving & (n > 0), 1)).alias("records_with_changes"),
                    F.count(F.when(F.col("push_status") == "success", 1)).alias("already_loaded"))
