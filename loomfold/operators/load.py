"""Loading records, and taking loads back.

``push`` sends records to a service through a caller-supplied function; its
outcome table is written once, because asking for it twice would send twice.
``load_into_table`` does the same against a table, as joins.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from loomfold.functions.text import col, filled, generalise, idempotency_key, strip, text_of
from loomfold.lineage import cut, small
from loomfold.spec import DEFAULT_POLICY, Policy, SchemaSpec

Send = Callable[[str, str], tuple[int, dict]]
OUTCOME = ("key string, code string, status int, attempts int, target_id string, message string, "
           "log array<struct<attempt:int,status:int,detail:string>>")


def payload(spec: SchemaSpec) -> Column:
    """The record body -- contract fields that hold a value, in contract order."""
    return F.to_json(F.struct(*[F.when(filled(col(n)), col(n)).alias(n) for n in spec.names]))


def ready(statuses: Sequence[str] = ("pending",)) -> Column:
    """No issues, no open question, and still to be sent."""
    return (F.size("issues") == 0) & (F.col("n_blocks") == 0) & F.col("push_status").isin(*statuses)


def to_send(records: DataFrame, spec: SchemaSpec, run_id: str, code: str = "employee_code") -> DataFrame:
    """(key, code, idempotency, payload) for records that are ready."""
    c = F.when(filled(col(code)), col(code)).otherwise(F.col("key"))
    return records.where(ready()).select("key", c.alias("code"), idempotency_key(run_id, c).alias("idempotency"),
                                         payload(spec).alias("payload"), col("_seq"))


def classify(status: Column, policy: Policy = DEFAULT_POLICY) -> Column:
    """success, failed (worth another try later) or rejected (a business answer)."""
    return F.when(status < 400, "success").when(status.isin(*policy.retryable_status), "failed").otherwise("rejected")


def push(batch: DataFrame, send: Send, policy: Policy = DEFAULT_POLICY, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """``send(payload, idempotency) -> (status, body)`` per record, retrying what deserves it.

    A lost executor makes Spark send its records again; the idempotency key is
    what makes that harmless.
    """
    retryable, tries, waits = set(policy.retryable_status), policy.push_attempts, policy.push_backoff

    def deliver(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for key, code, token, body in zip(pdf["key"], pdf["code"], pdf["idempotency"], pdf["payload"]):
                log, status, answer = [], 0, {}
                for attempt in range(1, tries + 1):
                    try:
                        status, answer = send(body, token)
                    except OSError as exc:                      # never arrived
                        status, answer = 503, {"error": str(exc)}
                    log.append({"attempt": attempt, "status": int(status), "detail": str(answer)[:300]})
                    if status not in retryable:
                        break
                    if attempt < tries:
                        sleep(waits[min(attempt - 1, len(waits) - 1)])
                rows.append((key, code, int(status), len(log), str(answer.get("id") or "") or None, str(answer.get("error") or "") or None, log))
            yield pd.DataFrame(rows, columns=["key", "code", "status", "attempts", "target_id", "message", "log"])

    sent = batch.select("key", "code", "idempotency", "payload").mapInPandas(deliver, OUTCOME)
    return cut(sent.withColumn("outcome", classify(F.col("status"), policy)))


def _met(target: DataFrame, batch: DataFrame, key: str, policy: Policy) -> DataFrame:
    """The target's rows that a batch can meet.  A batch of a checked size travels to the target, which is
    then filtered where it lies; a larger one is joined as a table of its size."""
    keys = batch.select(key)
    return target.join(F.broadcast(keys.distinct()), key, "left_semi") if small(keys, policy.broadcast_rows) else target


def load_into_table(batch: DataFrame, target: DataFrame, policy: Policy = DEFAULT_POLICY) -> tuple[DataFrame, DataFrame]:
    """Classify a batch (key, code, idempotency, _seq) against (code, target_id, idempotency).

    A blank code is refused, a known idempotency key replays its first result, an
    existing code is refused, anything else is created.  Inside the batch the
    first record of a code is created and later ones meet it.  Returns the
    outcomes and the rows to append to the target.
    """
    every = batch.withColumn("code", strip(text_of(F.col("code"))))
    blank, coded = every.where("code = ''"), every.where("code <> ''")         # blank codes need no look at the target: they would all meet in one task
    known = _met(target.where("idempotency IS NOT NULL"), coded, "idempotency", policy)
    done = known.groupBy("idempotency").agg(F.min("target_id").alias("_done"))
    have = _met(target, coded, "code", policy).groupBy("code").agg(F.lit(True).alias("_have"))
    # only codes that repeat inside the batch need an order among themselves
    first = (coded.groupBy("code").agg(F.count(F.lit(1)).alias("_n"), F.min_by(F.struct("_seq", "idempotency"), "_seq").alias("_first"))
             .where("_n > 1").select("code", "_first"))
    new_id = F.concat(F.lit("TGT-"), F.upper(F.substring(F.sha2(F.col("idempotency"), 256), 1, 12)))
    joined = (coded.join(done, "idempotency", "left").join(have, "code", "left").join(first, "code", "left")
              .withColumn("_later", F.coalesce(F.col("_seq") > F.col("_first._seq"), F.lit(False)))
              .withColumn("_again", F.col("_later") & F.col("_have").isNull() & (F.col("idempotency") == F.col("_first.idempotency"))))
    replay = F.col("_done").isNotNull() | F.col("_again")
    status = (F.when(replay, 200).when(F.col("_have").isNotNull() | F.col("_later"), 409).otherwise(201))
    taken = F.concat(F.lit("code "), "code", F.lit(" already exists in the target"))
    out = joined.withColumn("status", status).select(
        "key", "code", "status", F.when(F.col("status") == 200, F.coalesce("_done", new_id)).when(F.col("status") == 201, new_id).alias("target_id"),
        F.when(F.col("status") == 409, taken).alias("message"), classify(F.col("status"), policy).alias("outcome"), "idempotency")
    refused = blank.withColumn("status", F.lit(422)).select(
        "key", "code", "status", F.lit(None).cast("string").alias("target_id"), F.lit("code is required").alias("message"), classify(F.col("status"), policy).alias("outcome"), "idempotency")
    out = out.unionByName(refused)
    created = out.where("status = 201").select("code", "target_id", "idempotency")
    return out, created


def record_outcomes(records: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Write outcomes back to every record of the key."""
    said = outcomes.groupBy("key").agg(F.max(F.struct((F.col("outcome") == "success").alias("_good"), "status", "outcome", "target_id", "message")).alias("_o"))
    detail = F.when(F.col("_o.outcome") == "success", F.col("_o.target_id")).otherwise(F.col("_o.message"))
    return (records.join(said, "key", "left")
            .withColumns({"push_status": F.coalesce("_o.outcome", "push_status"),
                          "push_detail": F.when(F.col("_o").isNotNull(), F.coalesce(detail, F.lit(""))).otherwise(F.col("push_detail"))})
            .select(*records.columns))


def push_audit(outcomes: DataFrame, policy: Policy = DEFAULT_POLICY) -> DataFrame:
    good = F.col("outcome") == "success"
    return outcomes.where(F.col("outcome").isin("success", "failed")).select(
        F.when(good, "push_record").otherwise("push_failed").alias("action"), "key", F.lit("pending").alias("before"),
        F.when(good, F.concat(F.lit("created as "), F.coalesce("target_id", F.lit("unknown")))).otherwise("failed").alias("after"),
        F.when(good, "auto").otherwise("flagged").alias("disposition"),
        F.when(good, F.concat(F.lit("accepted "), "code")).otherwise(
            F.concat(F.lit(f"still failing after {policy.push_attempts} attempts: "), F.coalesce("message", F.lit("")))).alias("rationale"))


def rejection_flood(outcomes: DataFrame, policy: Policy = DEFAULT_POLICY, answer: str | None = None) -> DataFrame:
    """One row -- attempted, rejected, the leading reason, and whether it is one question."""
    refused = F.col("outcome") == "rejected"
    reason = F.when(refused, generalise(F.coalesce("message", F.lit(""))))
    by_reason = outcomes.groupBy("outcome", reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))      # one row per distinct reason
    one = by_reason.agg(F.sum("n").alias("attempted"), F.coalesce(F.sum(F.when(refused, F.col("n"))), F.lit(0)).alias("rejected"),
                        F.max(F.when(refused, F.struct("n", "reason"))).alias("t"))
    rejected, attempted, n = F.col("rejected"), F.col("attempted"), F.col("t.n")
    flood = ((rejected >= policy.rejection_flood_min) & (rejected / attempted >= policy.rejection_flood_rate)
             & (n / rejected >= policy.rejection_flood_rate) & F.lit(answer != "review"))
    return one.select("attempted", "rejected", F.col("t.reason").alias("reason"), n.alias("reason_count"), F.coalesce(flood, F.lit(False)).alias("flood"))


def rollback(records: DataFrame, keys: DataFrame, target: DataFrame, reason: str, code: str = "employee_code") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Take back loaded records.  Returns records, remaining target rows, audit.

    Only loaded records among the keys count; a row already gone is the wanted
    outcome, not a failure.
    """
    if not (reason or "").strip():
        raise ValueError("a reason is required: it goes into the audit trail")
    chosen = keys.select("key").distinct().withColumn("_chosen", F.lit(True))
    marked = records.join(chosen, "key", "left").withColumn("_back", F.coalesce(F.col("_chosen"), F.lit(False)) & (F.col("push_status") == "success"))
    gone = marked.where("_back").select(F.when(filled(col(code)), col(code)).otherwise(F.col("key")).alias("code")).distinct()
    updated = marked.withColumns({"push_status": F.when(F.col("_back"), "rolled_back").otherwise(F.col("push_status")),
                                  "push_detail": F.when(F.col("_back"), F.lit(reason)).otherwise(F.col("push_detail"))}).select(*records.columns)
    audit = marked.where("_back").select(F.lit("rollback_record").alias("action"), "key", F.lit("success").alias("before"),
                                         F.lit("rolled_back").alias("after"), F.lit(reason).alias("rationale")).distinct()
    taken = F.broadcast(gone) if small(keys.select("key"), DEFAULT_POLICY.broadcast_rows) else gone        # at most a code a key: the target is not shuffled
    return updated, target.join(taken, "code", "left_anti"), audit


def retry_targets(records: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """Failed records; with keys, also rolled-back ones among them.  Reset to pending."""
    if keys is None:
        again = records.where("push_status = 'failed'")
    else:
        again = records.where(F.col("push_status").isin("failed", "rolled_back")).join(keys.select("key").distinct(), "key", "left_semi")
    return again.withColumn("push_status", F.lit("pending"))


def push_totals(records: DataFrame) -> DataFrame:
    """A16 over all records of the run."""
    n = lambda s: F.count(F.when(F.col("push_status") == s, 1))         # noqa: E731
    return records.agg(n("success").alias("pushed"), n("failed").alias("push_failed"), n("rejected").alias("push_rejected"))


def carry_status(records: DataFrame, previous: DataFrame) -> DataFrame:
    """What is loaded or was taken back stays so when the analysis is run again."""
    kept = (previous.where(F.col("push_status").isin("success", "rolled_back")).groupBy("key")
            .agg(F.max_by(F.struct("push_status", "push_detail"), "_seq").alias("_p")))
    return (records.join(kept, "key", "left")
            .withColumns({"push_status": F.coalesce("_p.push_status", "push_status"), "push_detail": F.coalesce("_p.push_detail", "push_detail")})
            .select(*records.columns))
