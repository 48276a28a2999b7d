"""End to end on small tables of the shapes real exports have."""

from pyspark.sql import functions as F

from loomfold.operators.answers import answers_frame
from loomfold.plans.run import run
from loomfold.sources.tables import load_sources
from loomfold.specs.employee import EMPLOYEE

FIRST = ["Aarav", "Diya", "Rohan", "Ananya", "Karan", "Priya", "Arjun", "Sneha", "Rahul", "Meera", "Vikram", "Nisha"]
LAST = ["Sharma", "Patel", "Mehta", "Iyer", "Reddy", "Gupta", "Rao", "Kapoor", "Desai", "Nair", "Joshi", "Menon"]
DEPT = ["Engineering", "Sales", "Marketing", "Finance"]
HEAD = ["employee_code", "first_name", "last_name", "work_email", "date_of_birth", "date_of_joining", "department", "designation", "employment_type", "status"]


def person(i, **change):
    f, l = FIRST[i % 12], LAST[(i + i // 12) % 12]
    base = dict(zip(HEAD, [f"T{1000 + i}", f, l, f"{f}.{l}{i}@co.in".lower(), f"19{80 + i % 15}-0{1 + i % 9}-1{i % 9}", f"201{i % 9}-03-1{i % 9}", DEPT[i % 4], "Analyst", "Permanent", "Active"]))
    return {**base, **change}


def write(path, name, people):
    head = list(people[0])
    lines = [",".join(head)] + [",".join(f'"{p[h]}"' if "," in p[h] else p[h] for h in head) for p in people]
    (path / name).write_text("\n".join(lines) + "\n")
    return str(path / name)


def analyse(spark, paths, told=None, **kw):
    return run(load_sources(spark, paths), EMPLOYEE, answers=answers_frame(spark, told or {}), **kw)


def subjects(result):
    return {r["subject"] for r in result.questions.collect()}


def test_clean_data_is_not_interrogated(spark, tmp_path):
    result = analyse(spark, [write(tmp_path, "clean.csv", [person(i) for i in range(12)])])
    got = result.summary().collect()[0]
    assert (got["records"], got["records_ready"], got["questions"], got["columns_auto"], got["stopped"]) == (12, 12, 0, 10, None)


def test_every_planted_defect_is_one_question_and_answers_drain_the_queue(spark, tmp_path):
    people = [person(i, manager_email=person(0)["work_email"], date_of_exit="", pan="") for i in range(12)]
    people[1]["department"] = "Engg"
    people[2]["date_of_joining"] = "1970-01-01"
    people[3]["manager_email"] = people[4]["manager_email"] = "left@co.in"
    people[5]["manager_email"], people[6]["manager_email"] = people[6]["work_email"], people[5]["work_email"]
    people[7]["pan"] = people[8]["pan"] = "ABCDE1234F"
    people[9].update(date_of_birth="1985-09-09", first_name="Asha", last_name="Qureshi")
    people[10].update(date_of_birth="1985-09-09", first_name="Asha", last_name="Q.")
    people.append(dict(people[11]))                                                 # the same row twice
    path = write(tmp_path, "hr.csv", people)
    want = {"enum:department:engg", "record:T1002", "manager:left@co.in", "cycle:T1005|T1006", "rehire:T1007|T1008", "identity:T1009|T1010"}
    first = analyse(spark, [path])
    assert subjects(first) == want and first.records.count() == 12
    held = {r["key"]: r["n_blocks"] for r in first.records.collect()}
    assert held["T1001"] == held["T1003"] == held["T1007"] == held["T1010"] == 1 and held["T1000"] == 0
    assert {r["action"] for r in first.audit.select("action").distinct().collect()} >= {"merge_duplicate"}
    told = {"enum:department:engg": "Engineering", "record:T1002": {"action": "edit", "fields": {"date_of_joining": "2015-01-01"}}, "manager:left@co.in": "clear",
            "cycle:T1005|T1006": "cycle-clear:T1006", "rehire:T1007|T1008": "separate", "identity:T1009|T1010": "merge:T1009"}
    done = analyse(spark, [path], told)
    rows = {r["key"]: r for r in done.records.collect()}
    assert subjects(done) == set() and len(rows) == 11 and all(not r["issues"] and r["n_blocks"] == 0 for r in rows.values())
    assert rows["T1001"]["department"] == "Engineering" and rows["T1009"]["n_sources"] == 2 and rows["T1006"]["manager_email"] == ""
    trail = {(r["action"], r["entity"], r["after"]) for r in done.audit.collect()}
    assert {("resolve_rehire", "rehire:T1007|T1008", "separate"), ("resolve_duplicate", "identity:T1009|T1010", "merge:T1009")} <= trail


def test_two_files_with_different_identifiers(spark, tmp_path):
    hris = [{"Employee Code": p["employee_code"], "Official Email": p["work_email"], "full_name": f"{p['last_name']}, {p['first_name']}", "DOB": p["date_of_birth"], "Department": p["department"]} for p in map(person, range(10))]
    pay = [{"emp_id": p["employee_code"], "joining date": "15/03/2019", "role": "Analyst", "grade": "L1"} for p in map(person, range(4, 12))]
    result = analyse(spark, [write(tmp_path, "hris.csv", hris), write(tmp_path, "pay.csv", pay)])
    rows = {r["key"]: r for r in result.records.collect()}
    assert len(rows) == 12 and sum(r["n_sources"] == 2 for r in rows.values()) == 6
    assert (rows["T1004"]["first_name"], rows["T1004"]["grade"], rows["T1004"]["date_of_joining"]) == ("Karan", "L1", "2019-03-15")
    actions = {r["action"] for r in result.audit.select("action").distinct().collect()}
    assert {"infer_date_convention", "infer_name_order", "merge_duplicate"} <= actions


def test_an_ambiguous_date_column_is_one_question(spark, tmp_path):
    path = write(tmp_path, "d.csv", [person(i, date_of_joining=f"0{1 + i % 9}/0{1 + i % 8}/2015") for i in range(12)])
    first = analyse(spark, [path])
    assert subjects(first) == {"date:d.csv:date_of_joining"}
    again = analyse(spark, [path], {"date:d.csv:date_of_joining": "MDY"})
    assert subjects(again) == set() and again.records.where("date_of_joining = '2015-01-02'").count() == 1


def test_a_wrong_file_is_refused_once(spark, tmp_path):
    assets = [{"asset_tag": f"AST-{i}", "model": "X1", "serial_no": f"SN{i}", "warranty_months": "36", "condition": ["New", "Good", "Fair"][i % 3]} for i in range(12)]
    result = analyse(spark, [write(tmp_path, "assets.csv", assets)])
    assert subjects(result) == {"batch:coverage"} and result.stopped == "batch:coverage"


def test_a_missing_column_is_one_question(spark, tmp_path):
    people = [{k: v for k, v in person(i).items() if k != "work_email"} for i in range(12)]
    path = write(tmp_path, "n.csv", people)
    assert subjects(analyse(spark, [path])) == {"field:work_email"}
    free = analyse(spark, [path], {"field:work_email": "not_required"})
    assert subjects(free) == set() and free.audit.where("action = 'relax_required_field'").count() == 1


def test_a_flood_stops_the_run_without_listing_it(spark, tmp_path):
    path = write(tmp_path, "flood.csv", [person(i, first_name="Asha", last_name="Rao", date_of_birth="1990-01-01") for i in range(30)])
    result = analyse(spark, [path])
    assert subjects(result) == {"batch:rate"} and result.batch.collect()[0]["questions"] == 30 * 29 // 2
    assert result.batch.collect()[0]["blocked"] == 30 and result.records.where("n_blocks = 0").count() == 0
    assert subjects(analyse(spark, [path], {"batch:rate": "continue"})) == {f"identity:T{1000 + i}|T{1000 + j}" for i in range(30) for j in range(i + 1, 30)}


def test_tables_kept_on_the_way_can_be_released(spark):
    import os

    from loomfold import lineage

    folder = lambda df: df.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file:").replace("///", "/")
    other = lineage.keep(spark.range(3))
    with lineage.recorded() as paths:
        one, two = lineage.keep(spark.range(5)), lineage.keep(spark.range(7))
    late = lineage.keep(spark.range(4))
    folders = [folder(df) for df in (other, one, two, late)]
    lineage.release(spark, paths, two.where("id > 1"))
    assert [os.path.isdir(f) for f in folders] == [True, False, True, True] and two.count() == 7
    lineage.release(spark, paths)
    assert [os.path.isdir(f) for f in folders] == [True, False, False, True]
