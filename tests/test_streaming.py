from pyspark.sql import functions as F

from loomfold.specs.employee import EMPLOYEE
from loomfold.streaming.apply import checked, clean_as_decided, cleaned_stream, drain, first_per_identifier


def test_decided_rules_apply_to_a_stream(spark, tmp_path):
    rows = [("E1", "aarav SHARMA", " M ", "15/03/2021"), ("E2", "Diya Rao", "x", "03/04/2021")]
    spark.createDataFrame(rows, "code string, name string, sex string, doj string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("code string, name string, sex string, doj string").parquet(str(tmp_path / "in"))
    maps = [dict(column="code", target_field="employee_code"), dict(column="name", target_field="first_name", transform="split_full_name"),
            dict(column="sex", target_field="gender"), dict(column="doj", target_field="date_of_joining")]
    out = drain(checked(cleaned_stream(stream, maps, EMPLOYEE, {"doj": "DMY"}, {"enum:gender:x": "Other"}), EMPLOYEE), "t")
    got = {r["employee_code"]: r for r in out.collect()}
    assert (got["E1"]["first_name"], got["E1"]["last_name"], got["E1"]["gender"], got["E1"]["date_of_joining"], got["E1"]["status"]) == ("Aarav", "Sharma", "Male", "2021-03-15", "Active")
    assert (got["E2"]["gender"], got["E2"]["date_of_joining"]) == ("Other", "2021-04-03") and got["E1"]["issues"]


def test_repeats_within_the_delay_are_dropped(spark, tmp_path):
    df = spark.createDataFrame([("A", 1), ("a ", 2), ("B", 3)], "code string, n int").withColumn("ts", F.timestamp_seconds(F.col("n")))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    assert drain(first_per_identifier(stream, ["code"], "ts", "1 hour"), "u").count() == 2


def test_stream_and_batch_accept_the_same_words(spark, tmp_path):
    rows = [("E1", "Human Resource", "15/03/2021"), ("E2", "Zebra", "03/04/2021"), ("E3", "", "31/02/2021")]
    schema = "code string, dept string, doj string"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    words = spark.createDataFrame([("department", "human resource", "Human Resources")], "field string, value string, canonical string")
    maps = [dict(column="code", target_field="employee_code"), dict(column="dept", target_field="department"), dict(column="doj", target_field="date_of_joining")]
    out = {r["employee_code"]: r for r in drain(cleaned_stream(stream, maps, EMPLOYEE, {"doj": "DMY"}, words=words), "w").collect()}
    assert out["E1"]["department"] == "Human Resources" and out["E1"]["_edits"][0]["before"] == "Human Resource"
    assert out["E2"]["department"] == "" and out["E2"]["_questions"] == ["enum:department:zebra"] and out["E2"]["_waiting"] == ["department"]
    assert out["E3"]["date_of_joining"] == "" and "31/02/2021" in out["E3"]["_issues"][0] and out["E3"]["_questions"] == []


def test_rows_without_identifiers_all_stay(spark, tmp_path):
    df = spark.createDataFrame([("A", "x", 1), ("", "y", 2), (None, "z", 3), ("a", "w", 4)], "code string, v string, n int").withColumn("ts", F.timestamp_seconds(F.col("n")))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    assert {r["v"] for r in drain(first_per_identifier(stream, ["code"], "ts", "1 hour"), "b").collect()} == {"x", "y", "z"}


def test_words_decided_while_a_stream_runs_count_from_the_next_batch(spark, tmp_path):
    """Two runs of one query: the second batch meets the newer word, a repeated batch would replace itself, a word taken back is asked again."""
    schema, words = "code string, dept string", "field string, value string, canonical string, version int"
    maps = [dict(column="code", target_field="employee_code"), dict(column="dept", target_field="department")]
    where = {k: str(tmp_path / k) for k in ("in", "words", "out", "state")}

    def step(rows, decided):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(where["in"])
        spark.createDataFrame(decided, words).write.mode("append").parquet(where["words"])
        stream = spark.readStream.schema(schema).parquet(where["in"])
        clean_as_decided(stream, maps, EMPLOYEE, where["words"], where["out"], where["state"]).awaitTermination()

    step([("E1", "people ops"), ("E2", "odd")], [("department", "people ops", "Sales", 1), ("department", "odd", "Sales", 1)])
    step([("E3", "People Ops"), ("E4", "odd")], [("department", "people ops", "Human Resources", 2), ("department", "odd", None, 2)])
    out = spark.read.parquet(where["out"])
    got = {r["employee_code"]: (r["department"], r["batch"], list(r["_waiting"])) for r in out.collect()}
    assert got == {"E1": ("Sales", 0, []), "E2": ("Sales", 0, []), "E3": ("Human Resources", 1, []), "E4": ("", 1, ["department"])}
