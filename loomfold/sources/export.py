"""The migrated dataset as a table or files."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from loomfold.functions.text import col
from loomfold.operators.resolve import source_rows
from loomfold.spec import SchemaSpec


def export_frame(records: DataFrame, spec: SchemaSpec) -> DataFrame:
    """Contract columns in order, what happened to each record, and its source rows.

    Values are real, not masked.  ``sources`` is the inline list; a record with
    more rows than that holds says so and its rows are in the members table.
    """
    many = F.concat(F.col("n_sources").cast("string"), F.lit(" rows, see record_sources"))
    return records.select(
        *[col(n) for n in spec.names], F.col("push_status").alias("migration_result"),
        F.when(F.col("push_status") == "success", F.col("push_detail")).otherwise("").alias("target_id"),
        F.coalesce(F.array_join("sources", "; "), many).alias("source_rows"))


def write_export(records: DataFrame, members: DataFrame, spec: SchemaSpec, path: str, fmt: str = "csv") -> None:
    """Part files in parallel: ``records`` and the long ``record_sources`` (key, position, source), whole for every record."""
    out = export_frame(records, spec).write.mode("overwrite").format(fmt)
    (out.option("header", True).option("escape", '"') if fmt == "csv" else out).save(f"{path}/records")
    sources = source_rows(members).join(records.select("_rid", "key"), "_rid").select("key", "position", "source")
    writer = sources.write.mode("overwrite").format(fmt)
    (writer.option("header", True) if fmt == "csv" else writer).save(f"{path}/record_sources")
