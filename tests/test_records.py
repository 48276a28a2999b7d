from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from loomfold.lineage import cut
from loomfold.operators import clean as C, judge as J, load as L, profile as OP, review as W, validate as V
from loomfold.operators.answers import answers_frame, expand_skip_all
from loomfold.plans import plan as P, questions as Q, recipe as RC
from loomfold.sources.export import export_frame, write_export
from loomfold.sources.store import RunStore
from loomfold.sources.tables import as_text
from loomfold.spec import DEFAULT_POLICY
from loomfold.specs.employee import EMPLOYEE

GOOD = {"employee_code": "E1", "first_name": "Mia", "last_name": "Brown", "work_email": "m@example.com", "date_of_birth": "1987-11-24", "date_of_joining": "2008-10-27", "department": "Engineering",
        "designation": "Analyst", "employment_type": "Permanent", "status": "Active"}
META = ("key", "_rid", "_seq", "push_status", "push_detail", "n_sources")


def records(spark, items):
    out = []
    for i, item in enumerate(items):
        row = {**GOOD, "employee_code": f"E{i}", **item}
        out.append((row["employee_code"] or f"row{i}", f"r{i}", i, row.pop("push_status", "pending"), row.pop("push_detail", ""), 1, *[row.get(n, "") for n in EMPLOYEE.names]))
    types = ("string", "string", "long", "string", "string", "long")
    return spark.createDataFrame(out, ", ".join(f"{n} {t}" for n, t in zip(META, types)) + ", " + ", ".join(f"`{n}` string" for n in EMPLOYEE.names))


def rules(row):
    return {(i["field"], i["rule"]) for i in row["issues"]}


@pytest.mark.parametrize("change,want", [
    ({}, set()), ({"first_name": " "}, {("first_name", "required")}), ({"work_email": "nope"}, {("work_email", "format")}), ({"department": "Ops"}, {("department", "enum")}),
    ({"employee_code": "E" * 21}, {("employee_code", "length")}), ({"date_of_joining": "1980-01-01"}, {("date_of_joining", "order")}),
    ({"date_of_joining": "2000-01-01"}, {("date_of_joining", "age")}), ({"date_of_exit": "2008-10-26", "status": "Inactive"}, {("date_of_exit", "order")}),
    ({"date_of_exit": "2008-10-27", "status": "Inactive"}, set()), ({"status": "Inactive"}, {("status", "exit")}), ({"gender": "X"}, {("gender", "enum")})])
def test_checks(spark, change, want):
    assert rules(records(spark, [change]).withColumn("issues", V.check(EMPLOYEE)).collect()[0]) == want


def test_pending_is_not_invalid(spark):
    df = records(spark, [{"first_name": "", "status": "Inactive"}]).withColumn("w", F.array(F.lit("first_name"), F.lit("date_of_exit")))
    assert df.withColumn("issues", V.check(EMPLOYEE, waiting=F.col("w"))).collect()[0]["issues"] == []
    assert df.withColumn("issues", V.check(EMPLOYEE, suppress={"first_name", "status"})).collect()[0]["issues"] == []


def test_one_repair_then_ask(spark):
    got = V.validate_and_repair(records(spark, [
        {"pan": "abcde-1234 f"}, {"pan": "bad"}, {"uan": "1234 5678 9012"}, {"date_of_exit": "2010-01-01", "pan": "abcde1234f"}, {"pan": "abcde1234f", "status": ""}, {"date_of_exit": "2010-01-01"},
        {"first_name": "", "push_status": "skipped"}]), EMPLOYEE).orderBy("_seq").collect()
    assert got[0]["pan"] == "ABCDE1234F" and not got[0]["issues"] and [c["field"] for c in got[0]["changes"]] == ["pan"]
    assert rules(got[1]) == {("pan", "format")} and got[1]["pan"] == "BAD"
    assert got[2]["uan"] == "123456789012" and not got[2]["issues"]
    assert got[3]["status"] == "Inactive" and len(got[3]["changes"]) == 2 and not got[3]["issues"]
    assert got[4]["status"] == "Active"
    assert got[5]["status"] == "Active" and got[5]["changes"] == []                 # nothing failed, nothing is touched
    assert got[6]["issues"] == []
    audit = V.repair_audit(V.validate_and_repair(records(spark, [{"pan": "abcde1234f"}]), EMPLOYEE), EMPLOYEE).collect()[0]
    assert (audit["before"], audit["after"]) == ("******234f", "******234F")


def test_checks_are_not_repeated_by_what_follows(spark):
    """A filter on the issues is not rewritten as the checks themselves, which took each check dozens of times a row."""
    df = V.validate_and_repair(records(spark, [{"pan": "bad"}, {}]), EMPLOYEE).where(F.size("issues") > 0)
    assert [r["pan"] for r in df.collect()] == ["BAD"]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if line.lstrip(" :+-").startswith("Filter") and "RLIKE" in line]


def test_listed_issues_are_checked_once(spark):
    """Listing the issues of records does not put the checks into a filter of its own."""
    df = V.issues_of(records(spark, [{"pan": "bad"}, {}]), EMPLOYEE).select("key", F.inline("issues"))
    assert [(r["field"], r["rule"]) for r in df.collect()] == [("pan", "format")]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if line.lstrip(" :+-").startswith("Filter") and "RLIKE" in line]


@pytest.mark.parametrize("empty,total,structural", [(300, 300, True), (270, 300, True), (269, 300, False), (9, 9, False), (9, 10, True)])
def test_a_required_field_nothing_feeds(spark, empty, total, structural):
    df = records(spark, [{"work_email": "" if i < empty else "m@example.com"} for i in range(total)])
    row = V.missing_required(df, EMPLOYEE).where("field = 'work_email'").collect()[0]
    assert (row["missing"], row["structural"]) == (empty, structural)


def test_field_answers(spark):
    df = records(spark, [{"work_email": ""}, {}])
    out, hold, asked = V.apply_field_answers(df, ["work_email"], {"field:work_email": "skip_records"})
    assert [r["push_status"] for r in out.orderBy("_seq").collect()] == ["skipped", "pending"] and not hold and not asked
    assert V.apply_field_answers(df, ["work_email"], {"field:work_email": "not_required"})[1:] == ({"work_email"}, [])
    assert V.apply_field_answers(df, ["work_email"], {"field:work_email": "remap"})[1:] == ({"work_email"}, ["work_email"])


def test_answers_about_records(spark):
    told = answers_frame(spark, {"record:E0": {"action": "edit", "fields": {"pan": "ABCDE1234F", "employee_code": "N0"}}, "record:E1": {"action": "edit", "fields": {"grade": "L1"}}, "push:E1": "skip",
                                 "manager:old@x.com": {"action": "edit", "fields": {"manager_email": "New@X.com"}}, "cycle-clear:E2": True, "cycle:E2|E3": "cycle-clear:E3"})
    df = records(spark, [{"manager_email": "OLD@x.com"}, {}, {"manager_email": "m"}, {"manager_email": "m"}, {"manager_email": "m"}])
    out, audit = V.record_edits(df, told, EMPLOYEE)
    got = {r["_rid"]: r for r in V.reference_answers(out, told, "manager_email").collect()}
    assert (got["r0"]["key"], got["r0"]["pan"], got["r0"]["manager_email"]) == ("N0", "ABCDE1234F", "new@x.com")
    assert (got["r1"]["push_status"], got["r1"]["grade"]) == ("skipped", "")
    assert [got[f"r{i}"]["manager_email"] for i in (2, 3, 4)] == ["", "", "m"]
    trail = {(r["action"], r["key"], r["field"], r["after"]) for r in audit.collect()}
    assert ("correct_value", "N0", "pan", "******234F") in trail and ("skip_record", "E1", None, "skipped") in trail
    assert V.rekey_collisions(records(spark, [{"employee_code": "X"}, {"employee_code": "X"}])).count() == 1


# -- cleaning ----------------------------------------------------------------

def _one_column(spark, values, target, provenance="scored", answers=None):
    df = as_text(spark.createDataFrame([(v, i) for i, v in enumerate(values)], "c string, _pos long"), "hr.csv")
    maps = [dict(file="hr.csv", column="c", target_field=target, disposition="auto", provenance=provenance, transform=None)]
    return C.clean({"hr.csv": df}, maps, EMPLOYEE, OP.value_frequency({"hr.csv": df}), answers=answers)


RACES = ["White", "Black or African American", "Asian", "Two or more races", "Hispanic", "American Indian or Alaska Native"]


def test_values_that_contradict_the_mapping_are_one_question(spark):
    out = _one_column(spark, RACES, "gender")
    q = Q.vocabulary_questions(out.verdicts).collect()
    assert [x["subject"] for x in q] == ["map:hr.csv:c"] and q[0]["evidence"]["unmatched"] == "6" and out.unknown.count() == 0 and out.blocked == {"hr.csv": {"gender"}}
    told = _one_column(spark, RACES, "gender", provenance="human")
    assert Q.vocabulary_questions(told.verdicts).count() == 0 and told.unknown.count() == 6
    assert not _one_column(spark, RACES[:3], "gender").verdicts.collect()[0]["contradicted"]


def test_aliases_typos_and_answers(spark):
    out = _one_column(spark, ["M ", "F", "Femal", "zz", "zz"], "gender", answers={"enum:gender:zz": "__blank__"})
    assert [r["gender"] for r in out.rows.orderBy("_ord").collect()] == ["Male", "Female", "Female", "", ""]
    assert {(r["before"], r["after"]) for r in C.canonical_edits(out.rows).collect()} == {("M", "Male"), ("F", "Female"), ("Femal", "Female")}
    asked = _one_column(spark, ["Engg", "Engineering", "Human Resource", "  finance "], "department")
    q = Q.enum_questions(asked.unknown).collect()
    assert [x["subject"] for x in q] == ["enum:department:engg"] and q[0]["options"][0] == "Engineering" and q[0]["options"][-1] == "__blank__"
    rows = asked.rows.orderBy("_ord").collect()
    assert rows[0]["_waiting"] == ["department"] and rows[2]["department"] == "Human Resources" and rows[0]["status"] == "Active"


def test_unreadable_and_ambiguous_dates(spark):
    out = _one_column(spark, ["01/04/2010", "02/05/2011", "x"], "date_of_joining")
    rows = out.rows.orderBy("_ord").collect()
    assert out.blocked == {"hr.csv": {"date_of_joining"}} and [r["date_of_joining"] for r in rows] == ["", "", ""]
    assert rows[0]["_questions"] == ["date:hr.csv:c"] and rows[2]["_questions"] == [] and "unrecognised" in rows[2]["_issues"][0]
    told = _one_column(spark, ["01/04/2010", "x"], "date_of_joining", answers={"date:hr.csv:c": "DMY"})
    assert told.rows.orderBy("_ord").collect()[0]["date_of_joining"] == "2010-04-01" and C.convention_audit(told.conventions).collect()[0]["action"] == "set_date_convention"


# -- judging -----------------------------------------------------------------

@pytest.mark.parametrize("blocked,total,asked,want", [(4, 15, 4, None), (4, 15, 14, "rate"), (1, 1000, 40, "absolute"), (1, 1000, 39, None), (7, 7, 12, None), (2, 8, 12, "rate"), (2, 9, 12, None)])
def test_breaker(spark, blocked, total, asked, want):
    assert spark.range(1).select(J.breaker_trips(F.lit(blocked), F.lit(total), F.lit(asked)).alias("t")).collect()[0]["t"] == want


def test_a_wrong_file_needs_both_signals_low(spark):
    maps = lambda fields, n: spark.createDataFrame([("hr", f, f, "auto", None) for f in fields] + [("hr", f"x{i}", None, "ignored", None) for i in range(n)],     # noqa: E731
                                                   "file string, column string, target_field string, disposition string, transform string")
    wide = J.mapping_coverage(maps(["employee_code", "first_name", "last_name", "date_of_birth", "date_of_joining", "department", "designation", "status"], 50), EMPLOYEE).collect()[0]
    wrong = J.mapping_coverage(maps(["department", "gender"], 33), EMPLOYEE).collect()[0]
    assert not wide["stop"] and wrong["stop"] and wrong["required_found"] == 1
    split = spark.createDataFrame([("hr", "n", "first_name", "flagged", "split_full_name")], "file string, column string, target_field string, disposition string, transform string")
    assert J.mapping_coverage(split, EMPLOYEE).collect()[0]["required_found"] == 2


# -- loading -----------------------------------------------------------------

def _batch(spark, codes):
    return spark.createDataFrame([(f"K{i}", c, f"run:{c}", "{}", i) for i, c in enumerate(codes)], "key string, code string, idempotency string, payload string, _seq long")


def _service():
    """A nested function travels by value: Python workers do not import the tests."""
    def send(body, token):
        if token.endswith("down"):
            return 503, {"error": "busy"}
        if token.endswith("gone"):
            raise ConnectionError("unreachable")
        return (409, {"error": "exists"}) if token.endswith("dup") else (201, {"id": "T-" + token})
    return send


def test_push_retries_only_what_deserves_it(spark):
    got = {r["code"]: r for r in L.push(_batch(spark, ["ok", "down", "dup", "gone"]), _service(), sleep=lambda s: None).collect()}
    assert {c: (r["outcome"], r["attempts"]) for c, r in got.items()} == {"ok": ("success", 1), "down": ("failed", 3), "dup": ("rejected", 1), "gone": ("failed", 3)}
    assert got["ok"]["target_id"] == "T-run:ok" and [a["status"] for a in got["down"]["log"]] == [503, 503, 503]


def test_table_target(spark):
    target = spark.createDataFrame([("A", "T1", None), ("Z", "T2", "run:B")], "code string, target_id string, idempotency string")
    out, created = L.load_into_table(_batch(spark, ["A", "B", "", "C", "C", "D"]), target)
    assert [r["status"] for r in out.orderBy("key").collect()] == [409, 200, 422, 201, 200, 201] and {r["code"] for r in created.collect()} == {"C", "D"}


@pytest.mark.parametrize("rejected,total,answer,flood", [(5, 10, None, True), (4, 5, None, False), (5, 11, None, False), (5, 10, "review", False)])
def test_rejection_flood(spark, rejected, total, answer, flood):
    df = spark.createDataFrame([(f"K{i}", f"C{i}", "rejected" if i < rejected else "success", 409, f"code E10{i} exists") for i in range(total)], "key string, code string, outcome string, status int, message string")
    row = L.rejection_flood(df, answer=answer)
    assert row.collect()[0]["flood"] == flood
    subjects = [r["subject"] for r in Q.after_push(df, row).collect()]
    assert subjects == ["batch:push_rejected"] if flood else len(subjects) == rejected


def test_rollback_retry_and_carry(spark):
    df = records(spark, [{"push_status": s} for s in ("success", "success", "failed", "rolled_back", "pending")])
    keys = spark.createDataFrame([("E0",), ("E2",), ("E3",)], "key string")
    target = spark.createDataFrame([("E0",), ("E1",)], "code string")
    back, left, audit = L.rollback(df, keys, target, "wrong file")
    assert [r["push_status"] for r in back.orderBy("_seq").collect()] == ["rolled_back", "success", "failed", "rolled_back", "pending"]
    assert [r["code"] for r in left.collect()] == ["E1"] and [r["rationale"] for r in audit.collect()] == ["wrong file"]
    with pytest.raises(ValueError):
        L.rollback(df, keys, target, "  ")
    assert {r["key"] for r in L.retry_targets(df).collect()} == {"E2"} and {r["key"] for r in L.retry_targets(df, keys).collect()} == {"E2", "E3"}
    assert [r["push_status"] for r in L.carry_status(records(spark, [{}] * 5), df).orderBy("_seq").collect()] == ["success", "success", "pending", "rolled_back", "pending"]


def test_a_batch_answer_expands(spark):
    refs = spark.createDataFrame([("batch:push_rejected", "E1"), ("batch:push_rejected", "E2"), ("other", "E3")], "subject string, ref string")
    told = answers_frame(spark, {"batch:push_rejected": "skip", "push:E1": "edit-later"})
    assert {(r["subject"], r["value"]) for r in expand_skip_all(told, refs, "batch:push_rejected", "push").collect()} == {("batch:push_rejected", "skip"), ("push:E1", "edit-later"), ("push:E2", "skip")}


# -- plan, export, recipe, store ---------------------------------------------

def _finished(spark):
    df = V.validate_and_repair(records(spark, [{}, {"first_name": ""}, {"push_status": "success", "push_detail": "T-1"}, {"push_status": "failed"}, {"push_status": "rejected"}, {}]), EMPLOYEE)
    return df.withColumn("n_blocks", F.when(F.col("_seq") == 5, 2).otherwise(0).cast("long"))


def test_plan_sends_exactly_what_the_loader_sends(spark):
    df = cut(_finished(spark))
    plan = P.build_plan(df, EMPLOYEE)
    got = {r["key"]: (r["bucket"], r["reason_held"]) for r in plan.collect()}
    assert {k: b for k, (b, _) in got.items()} == {"E0": "will_send", "E1": "held_back", "E2": "settled", "E3": "will_send", "E4": "held_back", "E5": "held_back"}
    assert got["E5"][1] == "waiting on 2 open question(s)" and "first_name" in got["E1"][1] and got["E4"][1]
    sent = {r["key"]: r["payload"] for r in L.to_send(df, EMPLOYEE, "run").collect()}
    assert set(sent) == {"E0"} and sent["E0"] == plan.where("key = 'E0'").collect()[0]["payload"] and '"grade"' not in sent["E0"]
    totals = P.plan_totals(plan).collect()[0]
    assert totals["will_send"] + totals["held_back"] + totals["settled"] == 6 and totals["already_loaded"] == 1
    assert W.search_plan(plan, "will_send", "e3").count() == 1


def test_export(spark, tmp_path):
    df = cut(_finished(spark).withColumn("sources", F.when(F.col("_seq") < 5, F.array(F.lit("a#2"), F.lit("b#3")))))
    out = export_frame(df, EMPLOYEE)
    assert out.columns == EMPLOYEE.names + ["migration_result", "target_id", "source_rows"]
    got = {r["employee_code"]: r for r in out.collect()}
    assert got["E2"]["target_id"] == "T-1" and got["E0"]["target_id"] == "" and got["E0"]["source_rows"] == "a#2; b#3" and "record_sources" in got["E5"]["source_rows"]
    members = df.select("_rid", F.explode(F.coalesce("sources", F.array(F.lit("c#9")))).alias("_source"))
    write_export(df, members, EMPLOYEE, str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out/records"), header=True).count() == 6 and spark.read.csv(str(tmp_path / "out/record_sources"), header=True).count() == 11


def test_recipe_round_trip(spark):
    maps = spark.createDataFrame([("f", "Dept", "department", "auto", "scored", None, "x"), ("f", "Junk", None, "ignored", "scored", None, "no home")],
                                 "file string, column string, target_field string, disposition string, provenance string, transform string, reason string")
    trail = spark.createDataFrame([("infer_date_convention", "column:f:DOB", "ambiguous", "day/month/year", "why"), ("canonicalise_value", "f#2", "M", "Male", ""), ("canonicalise_value", "f#3", "m", "Male", "")],
                                  "action string, entity string, before string, after string, rationale string")
    told = answers_frame(spark, {"enum:gender:m": "Male", "identity:a|b": "merge:a", "record:E1": {"action": "edit", "fields": {"pan": "X"}}, "map:f:Junk": "__ignore__"})
    recipe = cut(RC.build_recipe(maps, trail, told, EMPLOYEE, "run"))
    by = {}
    for r in recipe.collect():
        by.setdefault(r["section"], []).append(r)
    assert [(r["from"], r["to"], r["how"], r["n"]) for r in by["value_mapping"]] == [("m", "Male", "confirmed", 0)] and by["date_convention"][0]["how"] == "inferred"
    assert {r["subject"] for r in by["answers"]} == {"enum:gender:m", "map:f:Junk"} and {r["subject"] for r in by["record_answers"]} == {"identity:a|b", "record:E1"}
    again = {r["subject"]: r for r in RC.replay_recipe(recipe, with_records=True).collect()}
    assert set(again) == {"enum:gender:m", "map:f:Junk", "identity:a|b", "record:E1"} and again["record:E1"]["fields"] == {"pan": "X"}
    with pytest.raises(ValueError, match="unsupported"):
        RC.replay_recipe(recipe.withColumn("recipe_version", F.lit(2)))
    with pytest.raises(ValueError, match="not a recipe"):
        RC.replay_recipe(maps)


def test_store(spark, tmp_path):
    store = RunStore(spark, str(tmp_path / "s"))
    q = Q.question(spark.createDataFrame([("a",), ("b",)], "s string"), "enum_value", F.col("s"), F.col("s"), F.array(F.lit("x")), {})
    store.replace_questions("r1", q)
    store.mark_resolved("r1", answers_frame(spark, {"a": "x"}))
    store.replace_questions("r1", q.where("subject = 'b'"))
    assert {(r["subject"], r["status"]) for r in store.read("questions", "r1").collect()} == {("a", "resolved"), ("b", "open")}
    store.save_answers("r1", answers_frame(spark, {"a": "1", "b": "2"}))
    store.save_answers("r1", answers_frame(spark, {"b": "3"}))
    assert {r["subject"]: r["value"] for r in store.read("answers", "r1").collect()} == {"a": "1", "b": "3"}
    store.replace("records", "r1", spark.range(3))
    store.replace("records", "r1", spark.range(0))
    assert store.read("records", "r1").count() == 0
    with pytest.raises(ValueError):
        store.seed_answers("r1", answers_frame(spark, {}))


def test_a_batch_is_looked_up_without_shuffling_the_target(spark):
    """A third of the batch without a code, a known key and a known code: same answers either way, and the target stays where it is."""
    from dataclasses import replace

    from loomfold.operators import load as L
    from loomfold.spec import DEFAULT_POLICY

    batch = spark.createDataFrame([(f"k{i}", "  " if i % 3 == 0 else f"C{i % 50}", f"run:{i}", i) for i in range(300)], "key string, code string, idempotency string, _seq long")
    target = spark.range(5000).selectExpr("concat('C', id * 7) AS code", "concat('T', id) AS target_id", "concat('run:', id * 11) AS idempotency")
    told = lambda p: sorted(tuple(r) for r in L.load_into_table(batch, target, p)[0].select("key", "code", "status", "target_id", "message").collect())
    near, far = told(DEFAULT_POLICY), told(replace(DEFAULT_POLICY, broadcast_rows=10))
    assert near == far and sum(r[2] == 422 for r in near) == 100 and {r[2] for r in near} == {200, 201, 409, 422}
    plan = L._met(target, batch, "code", DEFAULT_POLICY)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan.split("BroadcastExchange")[0]
