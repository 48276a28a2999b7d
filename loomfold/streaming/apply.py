"""Decided rules on a stream.

Cleaning and checking are stateless once conventions and words are settled, so the
same expressions run on a streaming DataFrame.  Identifier de-duplication keeps
bounded state behind a watermark.  Grouping and pair search stay batch work: call
them from ``foreachBatch``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from loomfold.functions.text import col, norm_key
from loomfold.lineage import scratch
from loomfold.operators.clean import cleaned_rows
from loomfold.operators.match import SPLIT
from loomfold.operators.validate import ROLES, Roles, check
from loomfold.spec import DEFAULT_POLICY, Policy, SchemaSpec


def cleaned_stream(stream: DataFrame, maps: Sequence[Mapping], spec: SchemaSpec, conventions: Mapping[str, str | None] | None = None,
                   answers: Mapping[str, str] | None = None, keep: Sequence[str] = (), words: DataFrame | None = None,
                   asking: Sequence[str] = (), contradicted: Sequence[str] = ()) -> DataFrame:
    """Accepted mappings applied to a stream; ``conventions``, ``asking`` and ``contradicted`` by column.

    The projection is the batch's own.  ``words`` (field, value, canonical) are the vocabulary words
    a batch has decided, joined as a static table; what is still open about a row stays with it in
    ``_waiting``, ``_questions``, ``_issues`` and ``_edits``.
    """
    placed = [{"transform": None, "file": "", **m} for m in maps]
    at = {m["column"]: (m["file"], m["column"]) for m in placed}
    fields = {m["target_field"] for m in placed if m["transform"] != SPLIT and spec.field(m["target_field"]).type == "enum"}
    fuzzy = {f: words.where(F.col("field") == f).select("value", "canonical").distinct() for f in fields} if words is not None else {}
    return cleaned_rows(stream, list(keep), placed, spec, {at[c]: v for c, v in (conventions or {}).items() if c in at},
                        {at[c] for c in asking if c in at}, {at[c] for c in contradicted if c in at}, fuzzy, dict(answers or {}))


def checked(stream: DataFrame, spec: SchemaSpec, policy: Policy = DEFAULT_POLICY, roles: Roles = ROLES) -> DataFrame:
    return stream.withColumn("issues", check(spec, policy=policy, roles=roles))


def first_per_identifier(stream: DataFrame, identifiers: Sequence[str], event_time: str, delay: str) -> DataFrame:
    """Drop repeats of the same identifiers that arrive within ``delay``; rows without any identifier all stay."""
    keyed = stream.withWatermark(event_time, delay).withColumns({f"_k_{n}": norm_key(col(n)) for n in identifiers})
    keys = [f"_k_{n}" for n in identifiers]
    named = F.concat(*keys) != ""
    once = keyed.where(named).dropDuplicatesWithinWatermark(keys)
    return once.unionByName(keyed.where(~named)).drop(*keys)


def newest(decisions: DataFrame, keys: Sequence[str], version: str = "version") -> DataFrame:
    """The last version of every decision; an emptied one (all other columns null) is taken back."""
    rest = [c for c in decisions.columns if c not in {*keys, version}]
    last = decisions.groupBy(*[col(k) for k in keys]).agg(F.max_by(F.struct(*[col(c) for c in rest]), version).alias("_d"))
    return last.select(*[col(k) for k in keys], *[F.col("_d")[c].alias(c) for c in rest]).where(F.coalesce(*[col(c) for c in rest]).isNotNull())


def clean_as_decided(stream: DataFrame, maps: Sequence[Mapping], spec: SchemaSpec, words_path: str, out: str, state: str, **rules):
    """A query that cleans each micro-batch by the words decided by then.

    ``words_path`` holds (field, value, canonical, version) as Parquet and may grow while the query
    runs: every micro-batch reads it anew, so a word that a person has settled counts from the next
    one on, without a restart.  A micro-batch is written under its number, so one that is repeated
    after a failure replaces itself.  Other arguments are those of ``cleaned_stream``.
    """
    def each(batch: DataFrame, number: int) -> None:
        words = newest(batch.sparkSession.read.parquet(words_path), ["field", "value"])
        cleaned_stream(batch, maps, spec, words=words, **rules).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", state).trigger(availableNow=True).start()


def drain(stream: DataFrame, name: str) -> DataFrame:
    """Run a stream over what is available now and read back what it wrote."""
    spark = stream.sparkSession
    folder = scratch(spark, name)
    out, state = f"{folder}/out", f"{folder}/state"
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
