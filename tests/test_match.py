from dataclasses import fields as dc_fields

import pytest
from pyspark.sql import functions as F

from loomfold.lineage import cut
from loomfold.operators import match as M
from loomfold.operators.profile import profile_columns
from loomfold.operators.answers import answers_frame, memory_from_answers, share_map_answers, update_memory
from loomfold.spec import DEFAULT_POLICY, Policy
from loomfold.specs.employee import EMPLOYEE

def profiles(spark, rows):
    """Profiles of columns given by their values; a third and fourth number overrule how many rows and distinct values there are."""
    frame = lambda data, ddl: spark.createDataFrame(data, ddl)                   # noqa: E731
    cells = frame([(f, c, i, v.strip(), 1, k) for i, (f, c, _, values, *_) in enumerate(rows) for k, v in enumerate(values)],
                  "file string, column string, column_pos int, value string, n long, min_pos long")
    facts = frame([(f, c, kind, *(more or (len(v), len(set(v))))) for f, c, kind, v, *more in rows], "file string, column string, inferred_type string, non_null long, cardinality long")
    own = profile_columns({}, cells).drop("inferred_type", "non_null", "cardinality")
    return own.join(facts, ["file", "column"])


def frequencies(spark, rows):
    return spark.createDataFrame([(f, c, v, 1) for f, c, _, values, *_ in rows for v in values], "file string, column string, value string, n long")


def test_policy_describes_every_threshold(spark):
    said = {r["name"] for r in DEFAULT_POLICY.describe(spark).collect()}
    assert {f.name for f in dc_fields(Policy)} - said == {"broadcast_rows", "inline_sources"}


@pytest.mark.parametrize("top,second,lexical,exact,want", [
    (1.0, 0.915, 1.0, False, "escalated"), (1.0, 0.915, 1.0, True, "auto"), (0.2, 0.1, 0.1, True, "ignored"), (0.82, 0.70, 1.0, False, "auto"), (0.82, 0.71, 1.0, False, "escalated"),
    (0.819, 0.1, 1.0, False, "escalated"), (0.5, 0.1, 1.0, False, "escalated"), (0.499, 0.1, 1.0, False, "ignored"), (0.69, 0.1, 0.44, False, "ignored"), (0.70, 0.1, 0.44, False, "escalated")])
def test_verdict_boundaries(spark, top, second, lexical, exact, want):
    row = spark.range(1).select(M.mapping_verdict(F.lit(top), F.lit(second), F.lit(lexical), F.lit(exact)).alias("v")).collect()[0]
    assert row["v"] == want


def test_alias_terms(spark):
    terms = {}
    for r in M.alias_terms(EMPLOYEE.fields_table(spark)).collect():
        terms.setdefault(r["field"], []).append(r["term"])
    assert terms["date_of_birth"] == ["date of birth", "DOB", "birth date"] and terms["gender"] == ["gender", "sex"] and "associate id" in terms["employee_code"]


@pytest.mark.parametrize("column,kind,samples,extra,field,want", [
    ("EmpID", "number", ["10026", "10084"], (), "phone", -0.45), ("MarriedID", "number", ["0", "1"], (300, 2), "employee_code", -0.45),
    ("EmpID", "id", [f"E{i}" for i in range(8)], (32, 30), "employee_code", 0.0), ("GenderID", "number", ["0", "1"], (), "gender", -0.45),
    ("Sex", "string", ["M ", "F"], (), "gender", 0.08), ("Salary", "number", ["62506"], (), "bank_account", -0.45), ("When", "date", ["2020-01-01"], (), "date_of_birth", 0.08),
    ("When", "string", ["x"], (), "date_of_birth", -0.18)])
def test_content_evidence(spark, column, kind, samples, extra, field, want):
    rows = [("f", column, kind, samples, *extra)]
    scored = M.score_candidates(profiles(spark, rows), EMPLOYEE, values=frequencies(spark, rows)).where(F.col("field") == field).collect()[0]
    lexical = scored["fuzzy_score"]
    assert scored["score"] == pytest.approx(max(0.0, min(1.0, lexical + want)))


def test_assignment_contest_answers_and_memory(spark):
    mail = ["a@x.com", "b@x.com", "c@y.org"]
    p = profiles(spark, [("f", "Official Email", "email", mail), ("f", "Mail ID", "email", mail), ("f", "Employee Name", "string", ["Aarav Sharma", "Diya Rao"]), ("f", "ctc_annual", "number", ["1", "2"], 2, 1),
                         ("g", "mail id", "email", mail)])
    by = lambda df: {(r["file"], r["column"]): r for r in df.collect()}          # noqa: E731
    first = by(M.match_columns(p, EMPLOYEE))
    assert first["f", "Official Email"]["contest"] == first["f", "Mail ID"]["contest"] == "work_email" and first["f", "ctc_annual"]["disposition"] == "ignored"
    told = answers_frame(spark, {"contest:f:work_email": "Official Email", "map:f:Employee Name": "first_name", "map:g:mail id": "personal_email"})
    settled = by(M.match_columns(p, EMPLOYEE, answers=answers_frame(spark, {"contest:f:work_email": "Official Email"})))
    assert (settled["f", "Official Email"]["target_field"], settled["f", "Official Email"]["provenance"]) == ("work_email", "human")
    assert settled["f", "Mail ID"]["target_field"] != "work_email"                  # the loser stays open
    then = by(M.match_columns(p, EMPLOYEE, answers=told))
    assert then["f", "Official Email"]["target_field"] == "work_email"
    assert then["f", "Employee Name"]["transform"] == "split_full_name"
    assert then["f", "Mail ID"]["target_field"] == "personal_email"                 # shared by header across files
    dropped = by(M.match_columns(p, EMPLOYEE, answers=answers_frame(spark, {"map:f:Mail ID": "__ignore__"})))
    assert dropped["f", "Mail ID"]["disposition"] == "ignored" and dropped["f", "Official Email"]["target_field"] == "work_email"
    memory = update_memory(spark.createDataFrame([], "subject string, column_key string, target string, times_used long"), told)
    recalled = by(M.match_columns(p, EMPLOYEE, memory=memory))
    assert (recalled["f", "Mail ID"]["disposition"], recalled["f", "Mail ID"]["provenance"]) == ("flagged", "memory")
    pending = {r["field"] for r in M.pending_fields(M.match_columns(p, EMPLOYEE)).collect()}
    assert "work_email" in pending


def test_whole_columns_decide(spark):
    """Eight placeholders first do not hide what a column holds."""
    odd = ["-", "tbd", "x1", "none given", "??", "a", "b", "c"]
    rows = [("f", "Employee Name", "string", odd + [f"Aarav Sharma{i}" for i in range(92)]), ("f", "Team", "string", odd + ["Engineering", "Sales"] * 46),
            ("f", "Reach", "string", odd + [f"m{i}@x.com" for i in range(92)]), ("f", "Reach 2", "string", ["m@x.com"] + [f"no {i}" for i in range(99)])]
    p = cut(profiles(spark, rows))
    got = {r["column"]: r for r in p.select("column", M.full_name_column().alias("full"), "shares").collect()}
    assert got["Employee Name"]["full"] and not got["Team"]["full"] and got["Reach"]["shares"]["format:email"] == pytest.approx(0.92)
    share = {(r["column"], r["field"]): r["recognised"] for r in M.recognised_shares(frequencies(spark, rows), p, EMPLOYEE, DEFAULT_POLICY).collect()}
    assert share["Team", "department"] >= 0.92 and share.get(("Reach", "department"), 0) < 0.05
    score = {(r["column"], r["field"]): r["score"] - r["fuzzy_score"] for r in M.score_candidates(p, EMPLOYEE, values=frequencies(spark, rows)).where("field = 'work_email'").collect()}
    assert score["Reach", "work_email"] >= -0.01 > score["Reach 2", "work_email"]    # one address in a hundred is no address column


def test_full_names_split_unasked(spark):
    p = profiles(spark, [("f", "first name of employee", "string", ["Aarav Sharma"]), ("g", "employee given", "string", ["A B"])])
    assert [r[0] for r in p.select(M.full_name_column()).collect()] == [False, False]
    q = profiles(spark, [("f", "full_name", "string", ["Sharma, Aarav", "Rao, Diya"])])
    row = M.match_columns(q, EMPLOYEE).collect()[0]
    assert (row["target_field"], row["transform"], row["disposition"]) == ("first_name", "split_full_name", "flagged")


def test_relative_scores_and_semantic_blend(spark):
    cos = spark.createDataFrame([("f", "c", f, v) for f, v in zip(EMPLOYEE.names, [0.9] + [0.5] * 20)], "file string, column string, field string, cosine double")
    rel = {r["field"]: r["relative"] for r in M.relative_semantic(cos).collect()}
    assert rel["employee_code"] == 1.0 and rel["status"] == 0.0
    flat = M.relative_semantic(cos.withColumn("cosine", F.lit(0.3))).agg(F.max("relative")).collect()[0][0]
    assert flat == 0.0
    p = profiles(spark, [("f", "c", "id", [f"E{i}" for i in range(5)])])
    top = M.score_candidates(p, EMPLOYEE, cosines=cos).where("rank = 1").collect()[0]
    assert top["field"] == "employee_code" and top["score"] == pytest.approx(0.6 + 0.4 * top["fuzzy_score"])


def test_memory_keeps_only_column_answers(spark):
    told = answers_frame(spark, {"map:f:Mail_ID": "personal_email", "contest:f:work_email": "Office Mail", "map:f:x": "__ignore__", "identity:a|b": "separate"})
    assert {(r["column_key"], r["target"]) for r in memory_from_answers(told).collect()} == {("mail id", "personal_email"), ("office mail", "work_email")}
    p = spark.createDataFrame([("g", "MAIL id"), ("f", "Mail_ID"), ("g", "other")], "file string, column string")
    assert {(r["file"], r["column"]): r["answer"] for r in share_map_answers(told, p).collect()} == {("g", "MAIL id"): "personal_email", ("f", "Mail_ID"): "personal_email"}


def test_the_sweep_accounts_for_every_known_column(spark):
    p = profiles(spark, [("f", "Emp ID", "id", [f"E{i}" for i in range(8)]), ("f", "Dept", "string", ["Engineering", "Sales"]), ("f", "ctc_annual", "number", ["1", "2"], 2, 1)]).cache()
    truth = spark.createDataFrame([("f", "Emp ID", "employee_code"), ("f", "Dept", "department"), ("f", "ctc_annual", "IGNORE")], "file string, column string, expected string")
    got = {(r["auto_min"], r["margin_min"]): (r["right"], r["asked"], r["wrong"]) for r in
           M.sweep_thresholds(p, M.score_candidates(p, EMPLOYEE), truth, EMPLOYEE, [0.6, 0.95], [0.0, 0.3]).collect()}
    assert len(got) == 4 and all(sum(v) == 3 and v[2] == 0 for v in got.values())
    assert got[0.6, 0.0][1] <= got[0.95, 0.3][1]                                    # a stricter cell never asks less


def test_only_values_that_can_reach_the_threshold_are_scored(spark, monkeypatch):
    """A page of text that holds an option of one letter is no word; what may score is kept."""
    from loomfold.functions.similarity import weighted_ratio
    from workloads.specs import TRADE

    page = "<p>office of the fox</p> " * 400
    values = [page, "F", "f", "of", "profiles", "profiles!", "building", "the building", "xx building " + "x" * 60, "buildings", "houshold", "a" * 12]
    seen, whole = set(), M.canonicalise
    monkeypatch.setattr(M, "canonicalise", lambda df, *more: (seen.update((r["field"], r["value"]) for r in df.collect()), whole(df, *more))[1])
    rows = [("f", "c", "string", values)]
    M.recognised_shares(frequencies(spark, rows), profiles(spark, rows), TRADE, DEFAULT_POLICY).collect()
    assert page.strip() not in {v for _, v in seen} and ("order_status", "profiles!") not in seen
    for field in TRADE.fields:
        for v in {v.lower() for v in values if v != page}:
            if any(weighted_ratio(v, o.lower()) >= DEFAULT_POLICY.enum_auto_min for o in field.enum or ()):
                assert (field.name, v) in seen


def test_letters_decide_what_is_scored_and_lose_no_word(spark, monkeypatch):
    """Values of an option's length, but of other letters, are not scored; every value that reaches the threshold is."""
    import random

    from loomfold.functions.similarity import weighted_ratio

    rng = random.Random(5)
    options = [o.lower() for f in EMPLOYEE.fields for o in f.enum or ()]

    def near(o: str) -> str:
        words_ = o.split() + rng.choices(["", "human", "success", "sales"], k=1) * rng.randint(0, 1)
        rng.shuffle(words_)
        letters = list("  ".join(words_))
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(letters) + 1)
            letters[at:at + rng.randint(0, 1)] = rng.choice(["", "e", "s", " ", "\t"])
        return "".join(letters)

    far = [f"user{i}@example.com" for i in range(300)] + [f"2001-0{i % 9 + 1}-11" for i in range(9)] + [f"98-{i:08d}" for i in range(300)]
    close = sorted({v.strip() for v in (near(o) for o in options for _ in range(60))} - {""})
    seen, whole = set(), M.canonicalise
    monkeypatch.setattr(M, "canonicalise", lambda df, *more: (seen.update((r["field"], r["value"]) for r in df.collect()), whole(df, *more))[1])
    rows = [("f", "c", "string", far + close)]
    M.recognised_shares(frequencies(spark, rows), profiles(spark, rows), EMPLOYEE, DEFAULT_POLICY).collect()
    assert not {v for _, v in seen} & set(far)
    for field in EMPLOYEE.fields:
        reached = {v for v in close for o in field.enum or () if weighted_ratio(v, o.lower()) >= DEFAULT_POLICY.enum_auto_min}
        assert {v for f, v in seen if f == field.name} >= reached


def test_few_bytes_of_words_are_scored_in_many_tasks(spark, monkeypatch):
    """Sizes do not merge the scoring into one task."""
    from loomfold.operators import vocabulary

    monkeypatch.setattr(vocabulary, "wratio", lambda a, b: F.spark_partition_id().cast("double"))
    values = spark.createDataFrame([("department", f"enginering {i}") for i in range(400)], "field string, value string")
    used = {r["score"] for r in vocabulary.canonicalise(values, EMPLOYEE).where("score < 100").collect()}
    assert len(used) == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_numbers_and_pages_are_not_lowered(spark, monkeypatch):
    """Values of columns that feed no vocabulary, and values far longer than any option, are left out before any work on their text."""
    seen, once = [], M.evaluated
    monkeypatch.setattr(M, "evaluated", lambda df, columns: (seen.extend(r.asDict() for r in df.collect()), once(df, columns))[1])
    rows = [("f", "size", "number", [str(i) for i in range(50)]), ("f", "page", "string", ["Sales " * 500, "Sales"]), ("f", "team", "string", ["Engineering", "Enginering", "Legal"])]
    p = cut(profiles(spark, rows))
    share = {(r["column"], r["field"]): r["recognised"] for r in M.recognised_shares(frequencies(spark, rows), p, EMPLOYEE, DEFAULT_POLICY).collect()}
    assert {(r["column"], r["value"]) for r in seen} == {("page", "Sales"), ("team", "Engineering"), ("team", "Enginering"), ("team", "Legal")}
    assert share["team", "department"] >= 2 / 3 and share["page", "department"] == 0.5 and not any(c == "size" for c, _ in share)
