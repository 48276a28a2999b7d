import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loomfold.functions import formats as FM
from loomfold.functions.text import few_words, strip, strip_stored, words
from loomfold.operators import dates as OD, profile as OP
from loomfold.sources.tables import BARE, as_text, from_table, load_source, load_sources


def _source(spark, file, rows, columns):
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], ", ".join(f"`{c}` string" for c in columns) + ", _pos long")
    return as_text(df, file)


def test_bom_zero_padding_quotes_and_header_blanks(spark, tmp_path):
    path = tmp_path / "bom.csv"
    path.write_bytes(b'\xef\xbb\xbfEmployee_Name, Zip\n"Brown, ""Mia""",01960\n,02148\n')
    df = load_source(spark, str(path))
    assert df.columns[:2] == ["Employee_Name", "Zip"]
    assert [tuple(r) for r in df.orderBy("_pos").select("Employee_Name", "Zip", "_source").collect()] == [
        ('Brown, "Mia"', "01960", "bom.csv#2"), ("", "02148", "bom.csv#3")]


def test_line_breaks_inside_quotes(spark, tmp_path):
    (tmp_path / "b.csv").write_text('Name,Note\n"Rao, A","first\nsecond ""line"""\nB,plain\n')
    rows = load_source(spark, str(tmp_path / "b.csv")).orderBy("_pos").select("Name", "Note", "_source").collect()
    assert [tuple(r) for r in rows] == [("Rao, A", 'first\nsecond "line"', "b.csv#2"), ("B", "plain", "b.csv#3")]


def test_rows_are_numbered_across_splits(spark, tmp_path):
    spark.range(3000).select(F.col("id").cast("string").alias("n"), F.repeat(F.lit("x"), 50).alias("pad")).coalesce(1).write.option("header", True).option(
        "maxRecordsPerFile", 700).csv(str(tmp_path / "big.csv"))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        df = load_source(spark, str(tmp_path / "big.csv"))
        assert df.rdd.getNumPartitions() > 8
        assert df.where("cast(n as long) <> _pos").count() == 0 and df.select("_pos").distinct().count() == 3000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_other_formats_and_refusals(spark, tmp_path):
    spark.range(5).select(F.col("id"), (F.col("id") * 1.5).alias("v")).coalesce(1).write.parquet(str(tmp_path / "t.parquet"))
    assert [r["v"] for r in load_source(spark, str(tmp_path / "t.parquet")).orderBy("_pos").collect()] == ["0.0", "1.5", "3.0", "4.5", "6.0"]
    spark.range(5).coalesce(1).write.json(str(tmp_path / "t.json"))
    assert load_source(spark, str(tmp_path / "t.json")).count() == 5
    with pytest.raises(ValueError, match="Unsupported"):
        load_source(spark, str(tmp_path / "t.xlsx"))
    with pytest.raises(ValueError, match="two sources"):
        load_sources(spark, [str(tmp_path / "t.json"), str(tmp_path / "t.json")])


@pytest.mark.parametrize("parts", [1, 5])
def test_profile(spark, parts):
    rows = [(f"E{1000 + i}", ["a@x.com", "NaN", " b@x.com "][i % 3], f"{10 + i}/03/2021", str(i % 2), f"+91 98200 0000{i}", "12.5") for i in range(9)]
    src = _source(spark, "f.csv", rows, ["code", "mail", "day", "PAN flag", "mobile", "amount"]).repartition(parts)
    got = {r["column"]: r for r in OP.profile_columns({"f.csv": src}).collect()}
    assert {c: r["inferred_type"] for c, r in got.items()} == {"code": "id", "mail": "email", "day": "date", "PAN flag": "number", "mobile": "phone", "amount": "number"}
    assert (got["mail"]["row_count"], got["mail"]["non_null"], got["mail"]["cardinality"]) == (9, 6, 2) and got["mail"]["samples"] == ["a@x.com", "b@x.com"]
    assert got["mail"]["shares"]["format:email"] == 1.0 and got["code"]["samples"] == [f"E{1000 + i}" for i in range(5)]
    assert got["PAN flag"]["pii_kind"] == "pan" and got["PAN flag"]["samples"] == ["*", "*"]
    approx = {r["column"]: r for r in OP.profile_columns_approx({"f.csv": src}).collect()}
    assert {c: r["inferred_type"] for c, r in approx.items()} == {c: r["inferred_type"] for c, r in got.items()} and approx["code"]["cardinality"] == 9


def test_placeholders_first_do_not_unmask_a_column(spark):
    values = ["n/a", "-", "x", "tbd", "?", "1", "2", "3"] + [f"{10 ** 13 + i}" for i in range(60)]
    src = _source(spark, "f", [(v,) for v in values], ["reference"])
    (row,) = OP.profile_columns({"f": src}).collect()
    assert row["pii_kind"] == "bank_account" and row["samples"][0] == "***"


@pytest.mark.parametrize("values,convention,anchors,outcome", [
    (["15/03/2021", "03/04/2021", "05/06/2020", "22/11/2019"], "DMY", 2, "ask"), (["03/04/2021", "05/06/2020"], None, 0, "ask"),
    (["15/03/2021", "16/03/2021", "17/03/2021", "03/04/2021"], "DMY", 3, "inferred"), (["2021-03-15", "2020-06-05"], "ISO", 0, "iso"),
    (["07/10/83", "05/05/75", "09/19/88", "09/27/88", "01/16/84", "11/24/87"], "MDY", 4, "inferred"), (["15/03/2021", "03/15/2021", "", "  "], "DMY", 2, "settled")])
def test_date_columns(spark, values, convention, anchors, outcome):
    vf = OP.value_frequency({"f": _source(spark, "f", [(v,) for v in values], ["d"])})
    row = OD.decide_conventions(OD.column_votes(vf)).collect()[0]
    assert (row["convention"], row["anchors"], row["outcome"]) == (convention, anchors, outcome)
    assert row["total"] == sum(1 for v in values if v.strip())
    assert OD.decide_conventions(OD.column_votes(vf), answers={"date:f:d": "MDY"}).collect()[0]["applied"] == "MDY"


def test_only_texts_are_trimmed(spark):
    """Numbers and dates are marked where they become text; the values of every column are counted as before."""
    rows = [(0, " a ", 1.5, -0.0), (1, "a", 1.5, 0.0), (2, " ", None, 2.0), (3, "é ", 3.0, float("nan")), (4, None, 3.0, 2.0)]
    df = from_table(spark.createDataFrame(rows, "id long, t string, x double, y double"), "f", "id")
    assert [df.schema[c].metadata[BARE] for c in ("id", "t", "x", "y")] == [True, False, True, True]
    text = lambda v: "" if v is None else "NaN" if v != v else str(v).strip()
    want = Counter((k, c, text(r[k])) for r in rows for k, c in enumerate(["id", "t", "x", "y"]))
    got = {(r["column_pos"], r["column"], r["value"]): r["n"] for r in OP.value_frequency({"f": df}).collect()}
    assert got == want


def test_shapes_are_told_early_and_the_same(spark):
    """Lengths and first characters spare a pattern only where it cannot fit."""
    rng = random.Random(3)
    parts = ["a", "Z", "ß", "ﬃ", "ABCDE", "1", "٣", "12345", "9876543210", "-", "/", ".", "@", "x.co", " ", " ", "\n", " ", "(", "+", "ſ", "𝟙"]
    made = {"".join(rng.choices(parts, k=rng.randint(0, 9))) for _ in range(4000)} | {"ABCDE1234F", "aßbc1234f", "ﬃab1234f", "ABCD0123456", "ﬃﬃ0ab1234", "1-2-3", "12.50", "1.2.3", "12345678901\n"}
    v = F.col("v")
    df = spark.createDataFrame([(x,) for x in sorted(made)], "v string")
    pairs = {f"shape {n}": (FM.has_shape(v, p, upper=True), F.upper(v).rlike(p)) for n, p in FM.SHAPES.items()}
    pairs |= {f"type {n}": (FM.type_shapes(v)[n], v.rlike(p)) for n, p in FM.TYPE_PATTERNS.items()}
    pairs |= {"words": (few_words(v, 2, 4), F.size(words(v)).between(2, 4)), "digits": (FM.many_digits(v), F.length(F.regexp_replace(v, r"(?U)\D", "")) >= 10),
              "strip": (strip_stored(v), strip(v))}
    new, old = df.select("v", *[a.alias(n) for n, (a, _) in pairs.items()]).collect(), df.select("v", *[b.alias(n) for n, (_, b) in pairs.items()]).collect()
    for n in pairs:
        assert [(r["v"], r[n]) for r in new] == [(r["v"], r[n]) for r in old], n
        assert len({r[n] for r in new}) > 1, n


def test_samples_come_without_a_sort_of_the_column(spark):
    """The first distinct values in file order, wherever they stand; only those of the first powers of two are ranked."""
    at = {"late": range(1000, 1400), "early": range(5), "spread": [0, 7, 900, 901, 5000, 5001, 9000], "blank": [], "odd": [-3, None, 0, 1, 2, 3]}
    rows = [("f", c, i, f"{c}{i}", 1, p) for c, positions in at.items() for i, p in enumerate(positions)] + [("f", "blank", 9, "", 3, 0), ("f", "spread", 9, "null", 1, 1)]
    vf = spark.createDataFrame(rows, "file string, column string, column_pos int, value string, n long, min_pos long")
    found = OP.first_distinct(vf)
    got = {r["column"]: r["raw_samples"] for r in found.collect()}
    assert got == {"late": [f"late{i}" for i in range(5)], "early": [f"early{i}" for i in range(5)], "spread": [f"spread{i}" for i in range(5)], "odd": ["odd1", "odd0", "odd2", "odd3", "odd4"]}
    ranked = [line for line in found._jdf.queryExecution().executedPlan().toString().split("\n") if "BroadcastHashJoin" in line]
    assert ranked
