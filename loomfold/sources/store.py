"""Run-scoped tables: one folder per table, one partition per run."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.errors import AnalysisException

from loomfold.lineage import cut


class RunStore:
    """Mappings, records, questions, audit, answers, push log and memory as Parquet.

    Rewrites of a table from its own contents are checkpointed first, so a run's
    partition is never read while it is being replaced.
    """

    def __init__(self, spark: SparkSession, base: str) -> None:
        self.spark, self.base = spark, base.rstrip("/")

    def _path(self, table: str, run_id: str | None = None) -> str:
        return f"{self.base}/{table}" + (f"/run_id={run_id}" if run_id else "")

    def replace(self, table: str, run_id: str, df: DataFrame) -> None:
        """Write beside, then switch: a write that fails leaves the old rows."""
        jvm, old = self.spark._jvm, self._path(table, run_id)
        beside = f"{self.base}/.{table}-{uuid.uuid4().hex}"
        df.write.parquet(beside)
        there, new = jvm.org.apache.hadoop.fs.Path(old), jvm.org.apache.hadoop.fs.Path(beside)
        fs = there.getFileSystem(self.spark._jsc.hadoopConfiguration())
        fs.mkdirs(there.getParent())
        fs.delete(there, True)
        if not fs.rename(new, there):
            raise OSError(f"{old} could not be replaced; its rows are in {beside}")

    def append(self, table: str, run_id: str, df: DataFrame) -> None:
        df.write.mode("append").parquet(self._path(table, run_id))

    def read(self, table: str, run_id: str) -> DataFrame:
        """One run's rows: the partition is named, so no other run is listed or read."""
        return self.spark.read.parquet(self._path(table, run_id))

    def read_all(self, table: str) -> DataFrame:
        return self.spark.read.parquet(self._path(table))

    def has(self, table: str, run_id: str | None = None) -> bool:
        try:
            self.spark.read.parquet(self._path(table, run_id)).schema
            return True
        except AnalysisException:
            return False

    # -- listings (T1) --
    def list_runs(self, limit: int = 25) -> DataFrame:
        return self.read_all("runs").orderBy(F.desc("created_at")).limit(limit)

    def list_records(self, run_id: str) -> DataFrame:
        return self.read("records", run_id).orderBy("key", "_seq")

    # -- questions --
    def replace_questions(self, run_id: str, questions: DataFrame) -> None:
        """The open set is rewritten, resolved questions stay as history."""
        new = questions.withColumns({"status": F.lit("open"), "resolution": F.lit(None).cast("string")})
        if self.has("questions", run_id):
            new = cut(self.read("questions", run_id).where("status <> 'open'").unionByName(new, allowMissingColumns=True))
        self.replace("questions", run_id, new)

    def mark_resolved(self, run_id: str, answers: DataFrame) -> None:
        said = answers.select("subject", F.coalesce("value", F.to_json("fields")).alias("_said"))
        now = self.read("questions", run_id).join(said, "subject", "left")
        hit = F.col("_said").isNotNull()
        self.replace("questions", run_id, cut(now.withColumns({
            "status": F.when(hit, "resolved").otherwise(F.col("status")),
            "resolution": F.coalesce("_said", "resolution")}).drop("_said")))

    # -- answers --
    def save_answers(self, run_id: str, answers: DataFrame) -> None:
        """A later answer to the same subject replaces the earlier one."""
        if self.has("answers", run_id):
            old = self.read("answers", run_id)
            answers = cut(old.join(answers.select("subject"), "subject", "left_anti").select(*answers.columns).unionByName(answers))
        self.replace("answers", run_id, answers)

    def seed_answers(self, run_id: str, answers: DataFrame) -> None:
        """Answers of a recipe, only before the run's first analysis."""
        if self.has("records", run_id):
            raise ValueError("this run has been analysed; apply a recipe to a fresh run")
        self.save_answers(run_id, answers)

    # -- push status --
    def update_records(self, run_id: str, update) -> None:
        self.replace("records", run_id, cut(update(self.read("records", run_id))))


def audit_rows(df: DataFrame, run_id: str, at: Column, actor: str, action: Column, entity: Column, before: Column, after: Column,
               rationale: Column, disposition: str = "auto") -> DataFrame:
    """Rows in the audit shape; ids follow from content, so a re-run writes the same ones."""
    body = df.select(F.lit(run_id).alias("run_id"), at.cast("string").alias("at"), F.lit(actor).alias("actor"), action.alias("action"), entity.alias("entity"),
                     before.cast("string").alias("before"), after.cast("string").alias("after"), rationale.alias("rationale"),
                     F.lit(disposition).alias("disposition"))
    ident = F.concat(F.lit("aud_"), F.substring(F.sha2(F.to_json(F.struct("run_id", "action", "entity", "before", "after")), 256), 1, 16))
    return body.withColumn("id", ident)
