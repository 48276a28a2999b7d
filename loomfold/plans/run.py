"""One analysis: ``run(sources, answers)`` is a pure function of its inputs.

A person's answer is an input to the next run, never a patch on its output.  The
driver sees only catalog-sized tables (profiles, mappings, conventions, word
rules) and counts; rows, records, members and references stay distributed.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from loomfold.functions.text import col, strip, text_of, subject_parts
from loomfold.lineage import cut, keep
from loomfold.operators import clean as C, judge as J, references as R, resolve as E, validate as V
from loomfold.operators.answers import answers_frame, kind_of, of_kind, rule_answers
from loomfold.operators.load import carry_status
from loomfold.operators.match import SPLIT, match_columns, pending_fields
from loomfold.operators.profile import profile_columns, union_all, value_frequency
from loomfold.plans import questions as Q
from loomfold.sources.store import audit_rows
from loomfold.spec import DEFAULT_POLICY, Policy, SchemaSpec

MAX_ROUNDS = 6


@dataclass
class RunResult:
    run_id: str
    profiles: DataFrame
    mappings: DataFrame
    records: DataFrame        # one row per record: fields, key, issues, n_blocks, push_status ...
    members: DataFrame        # which source rows made each record
    questions: DataFrame      # the open questions (only the breaker's, if it stopped the run)
    links: DataFrame          # (subject, _rid): which records each question holds up
    audit: DataFrame
    batch: DataFrame          # one row: counts and what, if anything, stopped the run
    stopped: str | None = None

    def summary(self) -> DataFrame:
        """One row of totals."""
        one = lambda df: df.withColumn("_k", F.lit(1))       # noqa: E731
        n, when = F.count, F.when
        cols = self.mappings.agg(n(F.lit(1)).alias("columns"), *[n(when(F.col("disposition") == d, 1)).alias(f"columns_{d}") for d in ("auto", "flagged", "ignored")])
        free = (F.size("issues") == 0) & (F.col("n_blocks") == 0) & ~F.col("push_status").isin("skipped", "success")
        recs = self.records.agg(n(F.lit(1)).alias("records"), n(when(free, 1)).alias("records_ready"), n(when(F.col("n_blocks") > 0, 1)).alias("records_blocked"),
                                n(when(F.col("push_status") == "skipped", 1)).alias("records_skipped"))
        asks, trail = self.questions.agg(n(F.lit(1)).alias("questions")), self.audit.agg(n(F.lit(1)).alias("audit_entries"))
        return one(cols).join(one(recs), "_k").join(one(asks), "_k").join(one(trail), "_k").drop("_k").withColumn("stopped", F.lit(self.stopped).cast("string"))


def _any(df: DataFrame) -> bool:
    return bool(df.limit(1).count())


@dataclass
class _Pairs:
    """Open near-duplicate pairs: counted by arithmetic; listed only when someone reads them."""
    n: int
    partners: DataFrame       # (_rid, n_partners)
    listed: DataFrame         # lazy


def _near_duplicates(records: DataFrame, spec: SchemaSpec, policy: Policy, answers: DataFrame, rules: Mapping[str, str], roles: V.Roles):
    """Questions about whole files, links, merge edges and the open pairs; answered pairs count nowhere."""
    named = cut(E.name_groups(records, roles.birth, "first_name", "last_name", spec.person_identifier))
    links = cut(E.near_name_links(named, policy))
    if not _any(links):
        return [], [], None, None
    told = cut(E.answered_pairs(named, links, answers))
    flood = cut(E.cross_file_flood(named, links, records, policy, told))
    top = next(iter(flood.where("flood").collect()), None)              # at most one row
    said = rules.get(top["subject"]) if top else None
    apart = (top["file_a"], top["file_b"]) if top is not None and said != "review" else None
    questions, blocks, edges = [], [], None
    if apart and said is None:
        questions.append(Q.flood_questions(flood))
        # every record of a linked name in one of the two files has a partner in the other
        inside = named.where(F.col("file").isin(*apart)).join(
            links.select("dob", "first", F.explode(F.array("value_a", "value_b")).alias("last")).distinct(), ["dob", "first", "last"], "left_semi")
        blocks.append(inside.select(F.lit(top["subject"]).alias("subject"), "_rid"))
    if apart and said == "merge_all":
        edges = E.merge_all_edges(named, links, *apart, spec.names)
        keys = records.select("_rid", "key")
        pair = E.pair_subject("identity", F.col("a.key"), F.col("b.key"))
        named_edges = (edges.join(keys.alias("a"), F.col("member") == F.col("a._rid")).join(keys.alias("b"), F.col("winner") == F.col("b._rid"))
                       .select("member", "winner", pair.alias("subject")))
        edges = named_edges.join(told.select("subject"), "subject", "left_anti").select("member", "winner")
    partners = cut(E.near_duplicate_records(named, links, told, apart).select("_rid", "n_partners"))
    n = partners.agg(F.coalesce(F.sum("n_partners"), F.lit(0))).collect()[0][0] // 2
    pairs = E.list_pairs(named, links)
    pairs = pairs.where(~E.between(*apart)) if apart else pairs
    return questions, blocks, edges, _Pairs(n, partners, pairs.join(told.select("subject").distinct(), "subject", "left_anti")) if n else None


def run(sources: Mapping[str, DataFrame], spec: SchemaSpec, run_id: str = "run", policy: Policy = DEFAULT_POLICY, answers: DataFrame | None = None,
        memory: DataFrame | None = None, cosines: DataFrame | None = None, previous: DataFrame | None = None, roles: V.Roles = V.ROLES) -> RunResult:
    spark: SparkSession = next(iter(sources.values())).sparkSession
    answers = answers_frame(spark, {}) if answers is None else answers
    rules = rule_answers(answers)
    now = F.current_timestamp()

    # evidence and decisions about columns
    vf = keep(value_frequency(sources))
    profiles = cut(profile_columns(sources, vf))
    mappings = cut(match_columns(profiles, spec, policy, answers, memory, cosines, values=vf))
    place = {f: i for i, f in enumerate(sources)}
    rows_of = sorted(mappings.collect(), key=lambda m: (place[m["file"]], m["column_pos"]))       # one per source column
    file_no = F.coalesce(*[F.when(F.col("file") == f, i) for f, i in place.items()], F.lit(len(place)))

    column_questions = [Q.mapping_questions(mappings, profiles, policy), Q.contest_questions(mappings)]
    coverage = J.mapping_coverage(mappings, spec, policy)
    halt = bool(coverage.where("stop").count()) and rules.get("batch:coverage") != "continue"
    if not C.accepted(rows_of):
        empty = spark.createDataFrame([], "run_id string, at string, actor string, action string, entity string, before string, after string, rationale string, disposition string, id string")
        bare = spark.createDataFrame([], "_rid string, key string, push_status string, n_blocks long, n_sources long, _seq long, issues array<" + V.ISSUE + ">, " + ", ".join(f"`{n}` string" for n in spec.names))
        asked = Q.coverage_question(coverage) if halt else union_all(column_questions)
        return RunResult(run_id, profiles, mappings, bare, spark.createDataFrame([], "_rid string, _source string"), asked,
                         spark.createDataFrame([], "subject string, _rid string"), empty, coverage, "batch:coverage" if halt else None)

    # rows, then records
    cleaned = C.clean(sources, rows_of, spec, vf, policy, rules)
    rows = keep(cleaned.rows)
    records, members = E.resolve_records(rows, spec, carry=("_waiting", "_questions"))
    records, members = keep(records), keep(members)
    records = records.withColumns({"push_status": F.lit("pending"), "push_detail": F.lit("")})
    column_questions += [Q.vocabulary_questions(cleaned.verdicts), Q.date_questions(cleaned.conventions)]
    ordered = union_all(column_questions).withColumns({"_f": file_no, "_s": F.when(F.col("evidence")["vocabulary_mismatch"].isNotNull(), 1).otherwise(0)})
    early = [J.one_per_column_name(ordered, ["_s", "_f", "subject"]).drop("_f", "_s", "also_in"), Q.enum_questions(cleaned.unknown)]
    blocks = [members.select(F.explode("_questions").alias("subject"), "_rid")]

    # people behind several records, and records that may be one person
    merges = E.answered_merges(answers, records)
    if spec.person_identifier:
        code = spec.record_identifiers[0]
        shared = E.shared_person_id(records, spec.person_identifier, code, roles.start).join(answers.select("subject"), "subject", "left_anti")
        early.append(Q.rehire_questions(shared))
        blocks.append(E.shared_person_refs(shared, records, spec.person_identifier).select("subject", "_rid"))
    asked, held_by, edges, pairs = _near_duplicates(records, spec, policy, answers, rules, roles)
    early += asked
    blocks += held_by
    merges = merges if edges is None else merges.unionByName(edges)
    parts = []
    if _any(merges):
        before = records
        records, members = E.apply_merges(records, members, cut(merges), spec)
        records, members = keep(records), keep(members)
        gone = before.select("_rid", F.col("key").alias("absorbed")).join(records.select("_rid"), "_rid", "left_anti").join(
            E.final_winners(merges).withColumnRenamed("member", "_rid"), "_rid").join(records.select(F.col("_rid").alias("winner"), "key"), "winner")
        parts.append(audit_rows(gone, run_id, now, "human", F.lit("merge_records"), F.col("key"), F.col("absorbed"), F.col("key"), F.lit("merged on an answer")))

    kind = kind_of(F.col("subject"))
    resolved = of_kind(answers, "identity", "rehire", "identity-batch").where("value IS NOT NULL")
    parts.append(audit_rows(resolved, run_id, now, "human", F.when(kind == "rehire", "resolve_rehire").when(kind == "identity", "resolve_duplicate").otherwise("resolve_duplicate_batch"),
                            F.col("subject"), F.lit("open"), F.col("value"), F.lit("answered in review")))

    # what is already under question, dataset-wide and per record
    pending = {r["field"] for r in pending_fields(mappings, policy).collect()} | {f for fs in cleaned.blocked.values() for f in fs}
    waits = members.select("_rid", F.explode("_waiting").alias("f")).groupBy("_rid").agg(F.array_sort(F.collect_set("f")).alias("waiting"))
    records = records.join(waits, "_rid", "left")
    if _any(answers.where(kind_of(F.col("subject")).isin("record", "push"))):
        records, edited = V.record_edits(records, answers, spec)
        parts.append(audit_rows(edited, run_id, now, "human", F.col("action"), F.col("key"), F.col("before"), F.col("after"), F.lit("supplied in review")))
    for pointer, _ in spec.reference_fields:
        if _any(answers.where(kind_of(F.col("subject")).isin("manager", "cycle", "cycle-clear"))):
            records = V.reference_answers(records, answers, pointer)

    # required fields nothing feeds, then the records themselves
    missing = cut(V.missing_required(records, spec, pending, policy))
    structural = [r["field"] for r in missing.where("structural").collect()]
    records, suppressed, fields_asked = V.apply_field_answers(records, structural, rules)
    held = pending | suppressed
    validated = keep(V.validate_and_repair(records, spec, held, "waiting", policy, roles))
    live = validated.where("push_status <> 'skipped'")
    late = [Q.record_questions(validated, spec, held), Q.field_questions(missing, fields_asked)]
    blocks.append(live.where(F.size("issues") > 0).select(F.concat(F.lit("record:"), "key").alias("subject"), "_rid"))
    blocks += [live.where(strip(text_of(col(n))) == "").select(F.lit(f"field:{n}").alias("subject"), "_rid") for n in fields_asked]
    for pointer, target in spec.reference_fields:
        if pending & {pointer, target}:
            once = spark.range(1)
            parts.append(audit_rows(once, run_id, now, "agent", F.lit("defer_hierarchy_check"), F.lit("dataset"), F.lit(None), F.lit(None),
                                    F.lit(f"{target} or {pointer} is still in question"), "flagged"))
            continue
        orphans = R.orphan_references(validated, target, pointer)
        orphans = cut(orphans.join(of_kind(answers, "manager").select(subject_parts(F.col("subject"), 2)(1).alias("missing")), "missing", "left_anti"))
        late.append(Q.orphan_questions(orphans))
        blocks.append(R.orphan_refs(orphans, validated, pointer).select("subject", "_rid"))
        graph = cut(R.reference_graph(validated, target, pointer))
        cycles = R.reference_cycles(graph)
        named = cut(R.cycle_subjects(cycles, graph).join(answers.select("subject"), "subject", "left_anti"))
        late.append(Q.cycle_questions(named))
        blocks.append(cycles.join(named.select("cycle", "subject"), "cycle").join(graph.select("node", "_rid"), "node").select("subject", "_rid"))

    # the batch as a whole
    links = cut(union_all(blocks).distinct())
    everything = cut(union_all([q.select(*early[-1].columns) for q in early + late]))
    finished = validated.join(J.block_counts(links), "_rid", "left").fillna(0, ["n_blocks"])
    refs, total = links.withColumnRenamed("_rid", "ref"), finished.agg(F.count(F.lit(1)).alias("n"))
    if pairs:
        finished = (finished.join(pairs.partners, "_rid", "left")
                    .withColumn("n_blocks", F.col("n_blocks") + F.coalesce("n_partners", F.lit(0))).drop("n_partners"))
        batch = J.batch_rate(everything, refs, total, policy, pairs.n, pairs.partners.select(F.col("_rid").alias("ref")))
        links = links.unionByName(pairs.listed.select("subject", F.explode(F.array("rid_a", "rid_b")).alias("_rid")))
        everything = everything.unionByName(Q.duplicate_questions(pairs.listed).select(*everything.columns), allowMissingColumns=True)
    else:
        batch = J.batch_rate(everything, refs, total, policy)
    batch = cut(batch)
    stopped = None
    open_questions = everything
    if halt:
        stopped, open_questions = "batch:coverage", Q.coverage_question(coverage)
    elif batch.where("tripped IS NOT NULL").count() and rules.get("batch:rate") != "continue":
        stopped, open_questions = "batch:rate", Q.rate_question(batch)
    if previous is not None:
        finished = carry_status(finished, previous)

    audit = _audit(run_id, now, sources, rows, cleaned, rows_of, vf, records, members, validated, spec, parts, structural, rules)
    return RunResult(run_id, profiles, mappings, finished, members, open_questions, links, audit, batch, stopped)


def _audit(run_id, now, sources, rows, cleaned, rows_of, vf, records, members, validated, spec, parts, structural, rules) -> DataFrame:
    """The trail: column rules once, value changes per row or record."""
    dates = C.convention_audit(cleaned.conventions)
    parts = list(parts)
    for actor in ("human", "agent"):
        mine = dates.where(F.col("actor") == actor)
        parts.append(audit_rows(mine, run_id, now, actor, F.col("action"), F.col("entity"), F.col("before"), F.col("after"), F.col("rationale"),
                                "auto" if actor == "human" else "flagged"))
    changed = C.cosmetic_changes(vf, rows_of, spec)
    parts.append(audit_rows(changed, run_id, now, "agent", F.lit("normalise_values"), F.concat(F.lit("column:"), "file", F.lit(":"), "column"),
                            F.concat(F.col("changed").cast("string"), F.lit(" values with stray spacing or casing")), F.lit("normalised"), F.lit("cosmetic")))
    for m in C.accepted(rows_of):
        if m["transform"] == SPLIT:
            order = C.name_order(sources[m["file"]], m["column"])
            parts.append(audit_rows(order, run_id, now, "agent", F.lit("infer_name_order"), F.lit(f"column:{m['file']}:{m['column']}"), F.lit("ambiguous"),
                                    F.col("order"), F.format_string("%d of %d values hold a comma", "with_comma", "sampled"), "flagged")
                         .withColumn("disposition", F.when(F.col("after") == "surname first", "auto").otherwise("flagged")))
    edits = C.canonical_edits(rows)
    parts.append(audit_rows(edits, run_id, now, "agent", F.lit("canonicalise_value"), F.col("_source"), F.col("before"), F.col("after"),
                            F.concat(F.lit("vocabulary of "), "field")))
    merged = records.where("n_sources > 1 AND basis IS NOT NULL")
    parts.append(audit_rows(merged, run_id, now, "agent", F.lit("merge_duplicate"), F.col("key"), F.concat(F.col("n_sources").cast("string"), F.lit(" rows")),
                            F.col("key"), F.concat(F.lit("rows share "), "basis")))
    fixed = V.repair_audit(validated, spec)
    parts.append(audit_rows(fixed, run_id, now, "agent", F.lit("repair_value"), F.col("key"), F.concat("field", F.lit("="), "before"),
                            F.concat("field", F.lit("="), "after"), F.col("why")))
    for name in structural:
        said = rules.get(f"field:{name}")
        if said in ("not_required", "skip_records"):
            action = "relax_required_field" if said == "not_required" else "skip_records_missing_field"
            parts.append(audit_rows(vf.sparkSession.range(1), run_id, now, "human", F.lit(action), F.lit(f"field:{name}"), F.lit("required"), F.lit(said),
                                    F.lit("no source column provides it")))
    return union_all(parts)
