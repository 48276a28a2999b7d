import datetime as dt
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from loomfold.functions import dates as D, formats as P, similarity as S, text as X
from loomfold.functions.vectors import cosine
from loomfold.specs.employee import EMPLOYEE


@pytest.mark.parametrize("raw,first,last", [
    ("Adinolfi, Wilson  K", "Wilson K", "Adinolfi"), ("Brown, Mia", "Mia", "Brown"), ("van der Berg, Jan", "Jan", "van der Berg"),
    ("Smith, John Jr.", "John Jr.", "Smith"), ("Wilson Adinolfi", "Wilson", "Adinolfi"), ("Mary Jane Watson", "Mary Jane", "Watson"),
    ("Jan van der Berg", "Jan", "van der Berg"), ("John Smith Jr", "John", "Smith Jr"), ("", "", ""), ("   ", "", ""),
    ("Madonna", "Madonna", ""), ("Adinolfi,", "", "Adinolfi"), (", Jan", "Jan", ""), ("Jr Sr", "Jr", "Sr"), ("van der berg", "van", "der berg")])
def test_split_name(one, raw, first, last):
    got = one([raw], X.split_name)[0]
    assert (got["first"], got["last"]) == (first, last)


def test_smart_title_touches_only_flat_words(one):
    assert one(["AARAV sharma", "McDonald O'Brien", "  x   Y2 "], X.smart_title) == ["Aarav Sharma", "McDonald O'Brien", "X Y2"]


@pytest.mark.parametrize("field,raw,want", [
    ("work_email", " A@X.Com ", "a@x.com"), ("phone", "+91 (98) 20", "+919820"), ("phone", "98-20 +1", "9820+1"), ("phone", "++1 2", "+12"), ("pan", "abcde 1234f", "ABCDE1234F"),
    ("ifsc", "hdfc 0001234", "HDFC0001234"), ("uan", "1000 0000 1", "100000001"), ("first_name", "DIYA  rao", "Diya Rao"), ("department", "Production       ", "Production"),
    ("location", "  Pune East ", "Pune East")])
def test_normalise(one, field, raw, want):
    assert one([raw], lambda c: X.normalise(c, EMPLOYEE.field(field))) == [want]


def test_masking(one):
    assert one(["ABCDE1234F", "123", "", None, " 12345 "], X.mask) == ["******234F", "***", "", "", "*2345"]
    assert one(["ABCDE1234F"], lambda c: X.redact_field("pan", c, EMPLOYEE.pii)) == ["******234F"]
    assert one(["Aarav"], lambda c: X.redact_field("first_name", c, EMPLOYEE.pii)) == ["Aarav"]


def test_abbreviates(one):
    pairs = [("q.", "qureshi", True), ("qu", "qureshi", True), ("qure", "qureshi", False), ("qureshi", "qureshi", False), ("", "x", False), ("sh", "qureshi", False)]
    got = one([f"{a}|{b}" for a, b, _ in pairs], lambda c: X.abbreviates(F.split(c, r"\|")[0], F.split(c, r"\|")[1]))
    assert got == [w for _, _, w in pairs]


def test_generalise_groups_messages_that_differ_by_code(one):
    a, b, c = one(["employee_code E1021 already exists", "employee_code E1022 already exists", "no code"], X.generalise)
    assert a == b and "<code>" in a and c == "no code"


def test_pair_subject_has_no_order(one):
    assert one(["b|a", "a|b"], lambda c: X.pair_subject("identity", F.split(c, r"\|")[0], F.split(c, r"\|")[1])) == ["identity:a|b"] * 2


def _read(spark, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r["r"] for r in D.with_readings(df, {"r": F.col("v")}).orderBy("i").collect()]


def test_single_dates(spark):
    day = dt.date(2021, 3, 15)
    r = _read(spark, ["15/03/2021", "03/15/2021", "03/04/2021", "2021-03-15", "15 Mar 2021", "Mar 15, 2021", "23/07/95", "23/07/05", "31/02/2021", "45/99/2021", "not a date", "",
                      "1/2-2020", "123/4/2021", "29/02/2024", "29/02/2023", "0000-01-01"])
    assert (r[0]["parsed"], r[0]["implies"]) == (day, "DMY") and (r[1]["parsed"], r[1]["implies"]) == (day, "MDY")
    assert r[2]["ambiguous"] and r[2]["parsed"] is None and r[2]["dmy"] == dt.date(2021, 4, 3) and r[2]["mdy"] == dt.date(2021, 3, 4)
    assert r[3]["parsed"] == r[4]["parsed"] == r[5]["parsed"] == day and r[3]["implies"] == "ISO" and r[4]["implies"] is None
    assert r[6]["parsed"] == dt.date(1995, 7, 23) and r[7]["parsed"] == dt.date(2005, 7, 23)
    assert r[8]["parsed"] is None and r[8]["implies"] == "DMY" and r[8]["error"] is None     # still votes
    assert r[9]["error"] and r[10]["error"] and r[11]["error"] == "empty" and r[12]["error"] and r[13]["implies"] == "DMY"
    assert r[14]["parsed"] == dt.date(2024, 2, 29) and r[15]["parsed"] is None and r[16]["parsed"] is None


def test_conventions_settle_only_what_is_ambiguous(spark):
    df = spark.createDataFrame([("03/04/2021",), ("15/03/2021",), ("31/02/2021",)], "v string")
    df = D.with_readings(df, {"r": F.col("v")})
    got = df.select(D.apply_convention(F.col("r"), "DMY").alias("d"), D.apply_convention(F.col("r"), "MDY").alias("m"), D.apply_convention(F.col("r"), None).alias("n")).collect()
    assert got[0]["d"]["date"] == dt.date(2021, 4, 3) and got[0]["m"]["date"] == dt.date(2021, 3, 4)
    assert got[0]["n"]["date"] is None and "no convention" in got[0]["n"]["error"]
    assert got[1]["m"]["date"] == dt.date(2021, 3, 15) and got[2]["d"]["error"] == "unreadable"


def test_formats(one):
    checks = {"email": ("a@b.co", "not-an-email"), "phone": ("+91 98200 00000", "12345"), "pan": ("ABCDE1234F", "abcde1234f"), "uan": ("123456789012", "1234"),
              "ifsc": ("HDFC0001234", "HDFC1001234"), "bank_account": ("123456789", "12345678")}
    for fmt, (good, bad) in checks.items():
        assert one([good, bad], lambda c: P.check_format(fmt, c)) == [True, False]


def test_pii_kinds(spark):
    seen = [("tax_ref", ["ABCDE1234F", "zxcvb9876k"]), ("PAN No", []), ("uan_number", []), ("Salary Account", []), ("designation", ["Engineer"]), ("x", ["1234 5678 9012"]),
            ("late", ["n/a"] * 8 + [f"{10 ** 11 + i}" for i in range(60)]), ("early", [f"{10 ** 11 + i}" for i in range(8)] + ["n/a"] * 60)]
    df = spark.createDataFrame([(c, v) for c, values in seen for v in values or [""]], "c string, v string")
    shares = df.groupBy("c").agg(P.shape_shares(F.col("v"), F.when(F.col("v") != "", 1).otherwise(0), F.sum(F.when(F.col("v") != "", 1).otherwise(0))).alias("s"))
    got = {r["c"]: r["k"] for r in shares.select("c", P.pii_kind(F.col("c"), F.col("s")).alias("k")).collect()}
    assert got == {"tax_ref": "pan", "PAN No": "pan", "uan_number": "uan", "Salary Account": "bank_account", "designation": None, "x": "aadhaar", "late": "aadhaar", "early": None}


def test_weighted_ratio_anchors():
    assert round(S.weighted_ratio("engg", "engineering"), 1) == 77.1
    assert round(S.weighted_ratio("human resource", "human resources"), 2) == 96.55
    assert S.weighted_ratio("", "x") == 0.0 and S.weighted_ratio("abc", "abc") == 100.0
    assert S.weighted_ratio("new york mets", "mets new york") == 95.0


def test_lcs_against_the_textbook_recurrence():
    rng = random.Random(5)
    for _ in range(200):
        a, b = ("".join(rng.choice("abcd") for _ in range(rng.randrange(9))) for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, j in itertools.product(range(len(a)), range(len(b))):
            table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
        assert S.lcs_lengths([a], [b])[0] == table[-1][-1]


def _plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def test_batched_lengths_of_any_size():
    rng = random.Random(9)
    texts = ["".join(rng.choice("abcé🙂 ") for _ in range(n)) for n in (0, 1, 2, 7, 40, 63, 64, 65, 127, 128, 130, 200, 333)]
    pairs = [(a, b) for a in texts for b in texts]
    assert S.lcs_lengths([a for a, _ in pairs], [b for _, b in pairs]).tolist() == [_plain_lcs(a, b) for a, b in pairs]
    assert S.weighted_ratios([], []).tolist() == [] and S.partial_ratios(["", "", "ab"], ["", "x", "xaby"]).tolist() == [100.0, 0.0, 100.0]


def test_a_word_in_a_third_of_a_block(spark):
    """The same links as comparing everything, and no candidates through the word that all share."""
    rng = random.Random(4)
    names = {"kumar", "kumar singh", "singh kumar"}
    stems = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(6, 14))) for _ in range(150)]
    for s in stems[:100]:
        names |= {f"kumar {s}", f"{s} kumar"} if rng.random() < 0.3 else {f"kumar {s}"}
    for s in stems:
        i = rng.randrange(len(s))
        names |= {s, f"kumar {s[:i]}{s[i + 1:]}" if rng.random() < 0.4 else s + "x"}
    for s, u in zip(stems[:40], stems[40:80]):
        names |= {f"{s} {u}", f"{u} {s} kumar", f"kumar {u} {s[:-1]}"}
    pairs = list(itertools.combinations(sorted(names), 2))
    want = {p for p, s in zip(pairs, S.weighted_ratios([a for a, _ in pairs], [b for _, b in pairs])) if s >= 92}
    df = spark.createDataFrame([("k", v) for v in names], "k string, v string")
    assert {(r["value_a"], r["value_b"]) for r in S.similar_values(df, ["k"], "v", 92.0, abbreviations=False).collect()} == want
    by_words = [f(df, ["k"], F.col("v"), X.words(F.col("v")), 0.92).count() for f in (S._by_rarest_word, S._by_rest)]
    assert sum(by_words) < 2 * len(names)                                           # not the square of the third


def test_similar_values_finds_what_comparing_everything_finds(spark):
    rng = random.Random(1)
    values = {"q", "q.", "qu", "sh"}
    for base in ("qureshi", "krishnamurthy", "van der berg", "o brien smith", "garcia marquez lopez"):
        for _ in range(18):
            x = list(base)
            for _ in range(rng.randint(0, 3)):
                i = rng.randrange(len(x))
                x[i:i + 1] = rng.choice([[], [rng.choice("abce ")], [x[i], rng.choice("abce")]])
            if "".join(x).strip():
                values.add("".join(x).strip())
        values.add(" ".join(reversed(base.split())))

    def short(a, b):
        a, b = sorted((re.sub("[^a-z]", "", a), re.sub("[^a-z]", "", b)), key=len)
        return a and a != b and len(a) <= 3 and b.startswith(a)

    want = {(a, b) for a, b in itertools.combinations(sorted(values), 2) if S.weighted_ratio(a, b) >= 92 or short(a, b)}
    df = spark.createDataFrame([("k", v) for v in values], "k string, v string")
    assert {(r["value_a"], r["value_b"]) for r in S.similar_values(df, ["k"], "v", 92.0).collect()} == want
    with pytest.raises(ValueError):
        S.similar_values(df, ["k"], "v", 80.0)


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [-1.0, 0.0]), ([0.0, 0.0], [1.0, 0.0]), (None, [1.0])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(cosine(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 0.0, 0.0]
