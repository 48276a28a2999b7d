"""Queries over columns and values: sources, profiles, text, dates, vocabularies."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomfold.functions import dates as D, formats as P, text as X
from loomfold.lineage import scratch
from loomfold.operators import clean as C, dates as OD, profile as OP, vocabulary as V
from loomfold.sources.tables import from_table, load_source
from workloads.inputs import ctes, derive, pad, plain, table
from workloads.specs import PERSON, SEGMENT, SEGMENTS

QUERIES, ORACLE = {}, {}


def query(oracle: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if oracle is not None:
            ORACLE[fn.__name__] = oracle
        return fn
    return register


# -- SQL pieces shared by oracles --------------------------------------------

def lcs_sql(a: str, b: str) -> str:
    """Length of the longest common subsequence of two texts, row by row of its table."""
    return (f"(CASE WHEN {a} = '' OR {b} = '' THEN 0 ELSE list_max(list_reduce("
            f"list_transform(string_split({a}, ''), lambda ch: list_transform(string_split({b}, ''), lambda d: CASE WHEN ch = d THEN 1 ELSE 0 END)), "
            "lambda above, hit: list_transform(range(1, len(hit) + 1), lambda j: list_max(list_transform(range(1, j + 1), "
            "lambda i: greatest(above[i], hit[i] + CASE WHEN i > 1 THEN above[i - 1] ELSE 0 END)))), "
            f"list_transform(string_split({b}, ''), lambda d: 0))) END)")


def ratio_sql(a: str, b: str) -> str:
    return f"(200.0 * {lcs_sql(a, b)} / (len({a}) + len({b})))"


def title_sql(x: str) -> str:
    return (f"array_to_string(list_transform(string_split({x}, ' '), lambda t: CASE WHEN t = upper(t) OR t = lower(t) "
            "THEN upper(substring(t, 1, 1)) || lower(substring(t, 2)) ELSE t END), ' ')")


def tidy_sql(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def mask_sql(x: str) -> str:
    return f"CASE WHEN len({x}) <= 4 THEN repeat('*', len({x})) ELSE repeat('*', len({x}) - 4) || right({x}, 4) END"


def melt_sql(source: str, file: str, cols: list[str], pos: str = "_pos") -> str:
    return " UNION ALL ".join(
        f"SELECT '{file}' AS file, '{c}' AS \"column\", trim(coalesce(CAST({c} AS VARCHAR), '')) AS value, {pos} AS pos FROM {source}" for c in cols)


# -- sources and profiles ----------------------------------------------------

_PROFILE_SQL = """
, vf AS (SELECT file, "column", value, count(*) AS n, min(pos) AS min_pos FROM cells GROUP BY ALL),
r AS (SELECT *, value <> '' AND lower(value) NOT IN ('nan', 'none', 'null') AS ok FROM vf),
s AS (SELECT file, "column", CAST(sum(n) AS BIGINT) AS row_count, CAST(sum(CASE WHEN ok THEN n ELSE 0 END) AS BIGINT) AS non_null, count(CASE WHEN ok THEN 1 END) AS cardinality,
  sum(CASE WHEN ok AND regexp_matches(value, '^[^@\\s]+@[^@\\s]+\\.[A-Za-z]{2,}$') THEN n ELSE 0 END) AS email,
  sum(CASE WHEN ok AND regexp_matches(value, '^(\\d{1,4}[-/.]\\d{1,2}[-/.]\\d{1,4}|\\d{1,2}\\s+[A-Za-z]{3,9}\\s+\\d{2,4}|[A-Za-z]{3,9}\\s+\\d{1,2},?\\s+\\d{2,4})$') THEN n ELSE 0 END) AS dates,
  sum(CASE WHEN ok AND regexp_matches(value, '^\\+?[\\d\\s\\-()]{9,20}$') THEN n ELSE 0 END) AS phone,
  coalesce(bool_or(CASE WHEN ok THEN len(regexp_replace(value, '\\D', '', 'g')) >= 10 END), false) AS long,
  sum(CASE WHEN ok AND regexp_matches(value, '^[A-Za-z]{1,4}[-_]?\\d{2,}$') THEN n ELSE 0 END) AS ids,
  sum(CASE WHEN ok AND regexp_matches(value, '^-?\\d+(\\.\\d+)?$') THEN n ELSE 0 END) AS num,
  sum(CASE WHEN ok AND regexp_matches(upper(value), '^[A-Z]{5}[0-9]{4}[A-Z]$') THEN n ELSE 0 END) AS s_pan,
  sum(CASE WHEN ok AND regexp_matches(value, '^\\d{4}\\s?\\d{4}\\s?\\d{4}$') THEN n ELSE 0 END) AS s_aadhaar,
  sum(CASE WHEN ok AND regexp_matches(value, '^\\d{12}$') THEN n ELSE 0 END) AS s_uan,
  sum(CASE WHEN ok AND regexp_matches(value, '^\\d{9,18}$') THEN n ELSE 0 END) AS s_bank
  FROM r GROUP BY ALL),
f AS (SELECT file, "column", list(value ORDER BY min_pos) AS samples FROM (
  SELECT *, row_number() OVER (PARTITION BY file, "column" ORDER BY min_pos) AS k FROM r WHERE ok) WHERE k <= 5 GROUP BY ALL),
k AS (SELECT s.*, coalesce(f.samples, []) AS samples, replace(lower(s."column"), '_', ' ') AS h FROM s LEFT JOIN f USING (file, "column")),
p AS (SELECT *, CASE WHEN contains(h, 'pan') OR contains(h, 'permanent account') THEN 'pan' WHEN contains(h, 'aadhaar') OR contains(h, 'aadhar') OR contains(h, 'uid') THEN 'aadhaar'
    WHEN contains(h, 'uan') OR contains(h, 'provident') OR contains(h, 'pf number') OR contains(h, 'pf no') THEN 'uan'
    WHEN contains(h, 'bank') OR contains(h, 'account no') OR contains(h, 'salary account') OR contains(h, 'ac no') THEN 'bank_account'
    WHEN non_null = 0 THEN NULL WHEN s_pan / non_null >= 0.8 THEN 'pan' WHEN s_aadhaar / non_null >= 0.8 THEN 'aadhaar'
    WHEN s_uan / non_null >= 0.8 THEN 'uan' WHEN s_bank / non_null >= 0.8 THEN 'bank_account' END AS pii_kind FROM k)
SELECT file, "column", row_count, non_null, cardinality,
  CASE WHEN non_null = 0 THEN 'string' WHEN email / non_null >= 0.7 THEN 'email' WHEN dates / non_null >= 0.7 THEN 'date' WHEN phone / non_null >= 0.7 AND long THEN 'phone'
    WHEN ids / non_null >= 0.7 THEN 'id' WHEN num / non_null >= 0.9 THEN 'number' ELSE 'string' END AS inferred_type, pii_kind,
  array_to_string(list_transform(samples, lambda v: CASE WHEN pii_kind IS NULL THEN v ELSE """ + mask_sql("v") + """ END), '|') AS samples FROM p"""


def _profile(df):
    return df.select("file", "column", "row_count", "non_null", "cardinality", "inferred_type", "pii_kind", F.array_join("samples", "|").alias("samples"))


_CUST = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
_ORD = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


@query("WITH cells AS (" + melt_sql("customer", "customer", _CUST, "c_custkey") + " UNION ALL " + melt_sql("orders", "orders", _ORD, "o_orderkey") + ")" + _PROFILE_SQL)
def profile_columns(spark, sf):
    """A0-A3, W7 over two tables read as text."""
    return _profile(OP.profile_columns({"customer": from_table(table(spark, sf, "customer"), "customer", "c_custkey"),
                                        "orders": from_table(table(spark, sf, "orders"), "orders", "o_orderkey")}))


@query("WITH cells AS (" + melt_sql("customer", "customer", _CUST, "c_custkey") + ")" + _PROFILE_SQL.split("\nf AS (SELECT")[0].rstrip().rstrip(",") +
       " SELECT file, \"column\", row_count, non_null, CASE WHEN non_null = 0 THEN 'string' WHEN email / non_null >= 0.7 THEN 'email' WHEN dates / non_null >= 0.7 THEN 'date' "
       "WHEN phone / non_null >= 0.7 AND long THEN 'phone' WHEN ids / non_null >= 0.7 THEN 'id' WHEN num / non_null >= 0.9 THEN 'number' ELSE 'string' END AS inferred_type FROM s")
def profile_one_pass(spark, sf):
    """The scan-only profile; its cardinality is approximate and left out here."""
    source = {"customer": from_table(table(spark, sf, "customer"), "customer", "c_custkey")}
    return OP.profile_columns_approx(source).select("file", "column", "row_count", "non_null", "inferred_type")


_IDS = ["tax_ref", "ref_a", "ref_b", "ref_c", "uid_text", "segment", "balance"]


@query(f"WITH {ctes('id_columns')}, cells AS (" + melt_sql("id_columns", "ids", _IDS) + ")" + _PROFILE_SQL)
def pii_profile(spark, sf):
    """Personal identifiers found by name and by shape, samples masked."""
    return _profile(OP.profile_columns({"ids": from_table(derive(spark, sf, "id_columns"), "ids", "_pos")}))


@query("SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_custkey AS pos, 'customer.parquet#' || CAST(c_custkey + 2 AS VARCHAR) AS source FROM customer")
def row_provenance(spark, sf):
    """S1/S2 on Parquet: the reader's own row index."""
    return load_source(spark, f"{sf.rstrip('/')}/customer.parquet").select("c_custkey", F.col("_pos").alias("pos"), F.col("_source").alias("source"))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, 'orders.csv#' || CAST(o_orderkey + 2 AS VARCHAR) AS source FROM orders")
def csv_provenance(spark, sf):
    """S1/S2 on CSV part files: rows numbered per split, split offsets added back."""
    path = scratch(spark, "csv") + "/orders.csv"
    table(spark, sf, "orders").write.option("header", True).option("maxRecordsPerFile", 4000).csv(path)
    return load_source(spark, path).select("o_orderkey", F.col("_source").alias("source"))


# -- text --------------------------------------------------------------------

@query(f"""WITH {ctes('people')} SELECT id, {title_sql(tidy_sql('first_name'))} AS first_name, {title_sql(tidy_sql('last_name'))} AS last_name,
  lower({tidy_sql('work_email')}) AS work_email,
  CASE WHEN {tidy_sql('phone')} LIKE '+%' THEN '+' || regexp_replace(phone, '\\D', '', 'g') ELSE regexp_replace(phone, '[^\\d+]', '', 'g') END AS phone,
  replace(upper({tidy_sql('pan')}), ' ', '') AS pan, replace({tidy_sql('uan')}, ' ', '') AS uan FROM people""")
def normalise_values(spark, sf):
    """one generated projection."""
    return derive(spark, sf, "people").select("id", *[X.normalise(F.col(n), PERSON.field(n)).alias(n)
                                                      for n in ("first_name", "last_name", "work_email", "phone", "pan", "uan")])


def _accept(file, pairs, transform=None, provenance="scored"):
    return [dict(file=file, column=c, target_field=t, disposition="auto", provenance=provenance, transform=transform) for c, t in pairs]


@query(f"""WITH {ctes('people')}, c AS (
  SELECT 'work_email' AS "column", trim(work_email) AS a, lower({tidy_sql('work_email')}) AS b FROM people UNION ALL
  SELECT 'first_name', trim(first_name), {title_sql(tidy_sql('first_name'))} FROM people UNION ALL
  SELECT 'pan', trim(pan), replace(upper({tidy_sql('pan')}), ' ', '') FROM people UNION ALL
  SELECT 'uan', trim(uan), replace({tidy_sql('uan')}, ' ', '') FROM people)
  SELECT 'people' AS file, "column", count(*) AS changed FROM c WHERE a <> '' AND b <> '' AND a <> b GROUP BY "column" """)
def cosmetic_changes(spark, sf):
    """A19 on distinct values."""
    cols = ["work_email", "first_name", "pan", "uan"]
    vf = OP.value_frequency({"people": from_table(derive(spark, sf, "people"), "people", "id")}, {"people": cols})
    return C.cosmetic_changes(vf, _accept("people", [(c, c) for c in cols]), PERSON)


_SUFFIX = "(?:jr|sr|ii|iii|iv|v|phd|md)"
_PARTICLE = "(?:van|von|de|del|della|der|den|di|da|dos|du|la|le|bin|binte|ibn|al)"
_CORE = f"(?i)^(\\S+ \\S+(?: \\S+)*?)((?: \\.*{_SUFFIX}\\.*)*)$"
_TAIL = f"(?i)^(\\S+(?: \\S+)*?)((?: {_PARTICLE})* \\S+)$"


@query(f"""WITH {ctes('full_names')}, t AS (SELECT id, {tidy_sql('full_name')} AS t FROM full_names),
  u AS (SELECT id, t, regexp_extract(t, '{_CORE}', 1) AS core, regexp_extract(t, '{_CORE}', 2) AS suffix, trim(split_part(t, ',', 1)) AS head,
    trim(CASE WHEN contains(t, ',') THEN substring(t, strpos(t, ',') + 1) ELSE '' END) AS rest FROM t)
  SELECT id, CASE WHEN t = '' THEN '' WHEN contains(t, ',') THEN CASE WHEN head <> '' AND rest = '' THEN '' ELSE rest END
      WHEN NOT contains(t, ' ') THEN t ELSE regexp_extract(core, '{_TAIL}', 1) END AS first_name,
    CASE WHEN t = '' THEN '' WHEN contains(t, ',') THEN head WHEN NOT contains(t, ' ') THEN ''
      ELSE trim(regexp_extract(core, '{_TAIL}', 2) || suffix) END AS last_name FROM u""")
def split_names(spark, sf):
    """comma, particles, suffixes, mononyms."""
    name = X.split_name(F.col("full_name"))
    return derive(spark, sf, "full_names").select("id", name["first"].alias("first_name"), name["last"].alias("last_name"))


@query(f"""WITH {ctes('full_names')}, f AS (SELECT {tidy_sql('full_name')} AS v FROM full_names WHERE trim(full_name) <> ''),
  a AS (SELECT count(*) AS sampled, count(CASE WHEN contains(v, ',') THEN 1 END) AS with_comma,
    count(CASE WHEN len(string_split(v, ' ')) > 2 THEN 1 END) AS long_names FROM f)
  SELECT *, CASE WHEN with_comma >= sampled * 0.5 THEN 'surname first' ELSE 'given name first' END AS "order",
    CASE WHEN with_comma >= sampled * 0.5 THEN 'auto' ELSE 'flagged' END AS disposition FROM a WHERE sampled > 0""")
def name_order(spark, sf):
    """Judged on all values of the column."""
    return C.name_order(derive(spark, sf, "full_names"), "full_name")


@query(f"""SELECT c_custkey, {mask_sql('c_name')} AS name, {mask_sql("CAST(c_nationkey AS VARCHAR)")} AS nation,
  trim(regexp_replace('code ' || c_name || ' E' || CAST(c_custkey AS VARCHAR) || '7-x exists', '\\b[A-Za-z]{{0,3}}\\d{{2,}}[A-Za-z0-9-]*\\b', '<code>', 'g')) AS reason,
  'p:' || least(c_name, c_mktsegment) || '|' || greatest(c_name, c_mktsegment) AS subject FROM customer""")
def mask_columns(spark, sf):
    """F13, F16, F17."""
    return table(spark, sf, "customer").select(
        "c_custkey", X.mask(F.col("c_name")).alias("name"), X.mask(F.col("c_nationkey")).alias("nation"),
        X.generalise(F.concat(F.lit("code "), "c_name", F.lit(" E"), F.col("c_custkey").cast("string"), F.lit("7-x exists"))).alias("reason"),
        X.pair_subject("p", F.col("c_name"), F.col("c_mktsegment")).alias("subject"))


@query(f"""WITH {ctes('people')}, c AS (
  SELECT 'email' AS format, trim(work_email) AS v, '^[^@\\s]+@[^@\\s]+\\.[A-Za-z]{{2,}}$' AS p FROM people UNION ALL
  SELECT 'phone', trim(phone), '^\\+?\\d[\\d\\s\\-()]{{7,17}}\\d$' FROM people UNION ALL SELECT 'pan', trim(pan), '^[A-Z]{{5}}[0-9]{{4}}[A-Z]$' FROM people UNION ALL
  SELECT 'uan', trim(uan), '^\\d{{12}}$' FROM people UNION ALL SELECT 'ifsc', 'HDFC' || {pad('id', 7)}, '^[A-Z]{{4}}0[A-Z0-9]{{6}}$' FROM people UNION ALL
  SELECT 'bank_account', '99' || CAST(id * 1000003 AS VARCHAR), '^\\d{{9,18}}$' FROM people)
  SELECT format, count(CASE WHEN regexp_matches(v, p) THEN 1 END) AS fits, count(*) AS total FROM c GROUP BY format""")
def format_checks(spark, sf):
    """Six formats over one melted pass."""
    people = derive(spark, sf, "people").selectExpr("work_email AS email", "phone", "pan", "uan", f"'HDFC' || {pad('id', 7)} AS ifsc",
                                                    "'99' || CAST(id * 1000003 AS STRING) AS bank_account")
    checks = [F.struct(F.lit(f).alias("format"), P.check_format(f, F.col(f)).alias("ok")) for f in P.FORMATS]
    return people.select(F.inline(F.array(*checks))).groupBy("format").agg(F.count(F.when(F.col("ok"), 1)).alias("fits"), F.count(F.lit(1)).alias("total"))


# -- dates -------------------------------------------------------------------

_MON = "(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]{0,6}"


def _read_sql(source: str, key: str) -> str:
    """SQL twin of the date reader: kind, parts, both readings."""
    dmy, mdy = f"(?i)^([0-9]{{1,2}})[\\s-]+({_MON})[\\s-]+([0-9]{{2,4}})$", f"(?i)^({_MON})[\\s-]+([0-9]{{1,2}}),?[\\s-]+([0-9]{{2,4}})$"
    num = "^([0-9]{1,4})(?:-([0-9]{1,2})-|/([0-9]{1,2})/|\\.([0-9]{1,2})\\.)([0-9]{1,4})$"
    ints = lambda p, i: f"CAST(nullif(regexp_extract(t, '{p}', {i}), '') AS INTEGER)"                                    # noqa: E731
    month = lambda p, i: f"CAST((strpos('janfebmaraprmayjunjulaugsepoctnovdec', lower(substring(regexp_extract(t, '{p}', {i}), 1, 3))) + 2) / 3 AS INTEGER)"
    year = lambda y: f"CASE WHEN {y} >= 100 THEN {y} WHEN {y} <= 30 THEN {y} + 2000 ELSE {y} + 1900 END"                 # noqa: E731
    cal = lambda y, m, d: f"CAST(try_strptime(printf('%04d-%02d-%02d', {y}, {m}, {d}), '%Y-%m-%d') AS DATE)"             # noqa: E731
    return f"""
  q AS (SELECT {key}, trim(text) AS t FROM {source}),
  g AS (SELECT *, regexp_matches(t, '{dmy}') AS w1, regexp_matches(t, '{mdy}') AS w2, regexp_matches(t, '{num}') AS nu, len(regexp_extract(t, '{num}', 1)) AS lead,
    {ints(num, 1)} AS a, coalesce({ints(num, 2)}, {ints(num, 3)}, {ints(num, 4)}) AS b, {ints(num, 5)} AS c,
    {ints(dmy, 1)} AS d1, {month(dmy, 2)} AS m1, {ints(dmy, 3)} AS y1, {month(mdy, 1)} AS m2, {ints(mdy, 2)} AS d2, {ints(mdy, 3)} AS y2 FROM q),
  h AS (SELECT *, CASE WHEN t = '' THEN 'empty' WHEN w1 OR w2 THEN 'worded' WHEN NOT nu THEN 'other' WHEN lead = 4 THEN 'ISO' WHEN a > 12 AND b <= 12 THEN 'DMY'
      WHEN b > 12 AND a <= 12 THEN 'MDY' WHEN a > 12 AND b > 12 THEN 'neither' ELSE 'either' END AS kind, {year('c')} AS yc, {year('y1')} AS yy1, {year('y2')} AS yy2 FROM g),
  read AS (SELECT *, {cal('yc', 'b', 'a')} AS as_dmy, {cal('yc', 'a', 'b')} AS as_mdy,
    CASE WHEN kind = 'worded' THEN CASE WHEN w1 THEN {cal('yy1', 'm1', 'd1')} ELSE {cal('yy2', 'm2', 'd2')} END WHEN kind = 'ISO' THEN {cal('a', 'b', 'c')}
      WHEN kind = 'DMY' THEN {cal('yc', 'b', 'a')} WHEN kind = 'MDY' THEN {cal('yc', 'a', 'b')} END AS parsed,
    CASE WHEN kind IN ('ISO', 'DMY', 'MDY') THEN kind END AS implies,
    CASE kind WHEN 'empty' THEN 'empty' WHEN 'other' THEN 'unrecognised format' WHEN 'neither' THEN 'neither component can be a month' END AS error FROM h)"""


@query(f"WITH {ctes('order_dates')}, {_read_sql('order_dates', 'o_orderkey')} SELECT o_orderkey, CAST(parsed AS VARCHAR) AS parsed, kind = 'either' AS ambiguous, implies, error FROM read")
def read_dates(spark, sf):
    """What one text says about itself."""
    read = D.with_readings(derive(spark, sf, "order_dates"), {"r": F.col("text")})
    return read.select("o_orderkey", F.col("r.parsed").cast("string").alias("parsed"), "r.ambiguous", "r.implies", "r.error")


@query(f"""WITH {ctes('order_dates')}, {_read_sql('order_dates', 'o_orderkey')},
  f AS (SELECT *, coalesce(parsed, CASE WHEN kind = 'either' THEN as_dmy END) AS v FROM read)
  SELECT o_orderkey, CAST(v AS VARCHAR) AS date, CASE WHEN v IS NOT NULL THEN NULL WHEN error IS NOT NULL THEN error WHEN kind <> 'either' THEN 'unreadable' ELSE 'not a real calendar date' END AS error FROM f""")
def apply_dates(spark, sf):
    """one column read day first."""
    read = D.with_readings(derive(spark, sf, "order_dates"), {"r": F.col("text")})
    out = read.select("o_orderkey", D.apply_convention(F.col("r"), "DMY").alias("d"))
    return out.select("o_orderkey", F.col("d.date").cast("string").alias("date"), "d.error")


_DATECOLS = ["day_first", "month_first", "iso", "unclear", "mixed", "unreadable"]


@query(f"""WITH {ctes('date_columns')}, cells AS ({melt_sql('date_columns', 'orders', _DATECOLS)}), texts AS (SELECT *, value AS text, "column" || '#' || CAST(pos AS VARCHAR) AS id FROM cells),
  {_read_sql('texts', 'id')}, v AS (SELECT split_part(id, '#', 1) AS "column", count(*) AS total, count(CASE WHEN implies = 'DMY' THEN 1 END) AS d, count(CASE WHEN implies = 'MDY' THEN 1 END) AS m,
    count(CASE WHEN implies = 'ISO' THEN 1 END) AS i, count(CASE WHEN kind = 'either' THEN 1 END) AS ambiguous, count(error) AS unreadable FROM read WHERE t <> '' GROUP BY 1),
  w AS (SELECT "column", total, d + m AS anchors, CASE WHEN d + m > 0 THEN greatest(d, m) / (d + m) WHEN i > 0 AND ambiguous = 0 THEN 1.0 ELSE 0.0 END AS agreement,
    CASE WHEN d + m > 0 AND d >= m THEN 'DMY' WHEN d + m > 0 THEN 'MDY' WHEN i > 0 AND ambiguous = 0 THEN 'ISO' END AS convention, ambiguous, unreadable FROM v),
  x AS (SELECT *, CASE WHEN "column" = 'unclear' THEN 'confirmed' WHEN convention = 'ISO' THEN 'iso' WHEN convention IS NOT NULL AND anchors >= 3 AND agreement >= 0.9 THEN 'inferred'
    WHEN ambiguous = 0 THEN 'settled' ELSE 'ask' END AS outcome FROM w)
  SELECT 'orders' AS file, "column", total, anchors, round(agreement, 6) AS agreement, convention, ambiguous, unreadable, outcome,
    CASE WHEN outcome = 'confirmed' THEN 'MDY' WHEN outcome <> 'ask' THEN convention END AS applied FROM x""")
def date_convention(spark, sf):
    """A4, A5: one vote per distinct text, one decision per column, one answered."""
    vf = OP.value_frequency({"orders": from_table(derive(spark, sf, "date_columns"), "orders", "_pos")})
    out = OD.decide_conventions(OD.column_votes(vf), answers={"date:orders:unclear": "MDY"})
    return out.withColumn("agreement", F.round("agreement", 6))


# -- vocabularies ------------------------------------------------------------

_OPTIONS = "(SELECT unnest([" + ", ".join(f"'{s}'" for s in SEGMENTS) + "]) AS option)"
_WORDS = f"""{ctes('segments')}, vals AS (SELECT 'segment' AS field, lower({tidy_sql('segment')}) AS value, _pos FROM segments UNION ALL SELECT 'other', lower({tidy_sql('other')}), _pos FROM segments),
  cnt AS (SELECT field, value, count(*) AS n FROM vals WHERE value <> '' GROUP BY ALL),
  scored AS (SELECT field, value, n, option, CASE WHEN value = lower(option) THEN 100.0
    WHEN field = 'segment' AND ((value = 'cars' AND option = 'Automobile') OR (value = 'homes' AND option = 'Household')) THEN 100.0
    WHEN greatest(len(value), len(option)) / least(len(value), len(option)) >= 1.5 AND contains(lower(option), value) THEN 90.0
    ELSE {ratio_sql('value', 'lower(option)')} END AS score FROM cnt, {_OPTIONS} o),
  words AS (SELECT field, value, any_value(n) AS n, max(score) AS top, arg_max(option, score) AS best FROM scored GROUP BY field, value)"""


def _values(spark, sf):
    source = {"seg": from_table(derive(spark, sf, "segments"), "seg", "_pos")}
    maps = _accept("seg", [("segment", "segment"), ("other", "other")])
    return C.vocabulary_values(OP.value_frequency(source), maps, SEGMENT, _policy(), {})


def _policy():
    from loomfold.spec import DEFAULT_POLICY
    return DEFAULT_POLICY


@query(f"WITH {_WORDS} SELECT field, value, CASE WHEN top >= 90 THEN best END AS canonical, CASE WHEN top >= 90 THEN round(top, 4) END AS score FROM words")
def canonicalise(spark, sf):
    """Distinct words only."""
    return _values(spark, sf).select("field", "value", "canonical", F.when(F.col("canonical").isNotNull(), F.round("score", 4)).alias("score"))


_FIT = f"{_WORDS}, fit AS (SELECT field, count(*) AS total_values, count(CASE WHEN top < 90 THEN 1 END) AS unmatched FROM words GROUP BY field)"


@query(f"WITH {_FIT} SELECT field, total_values, unmatched, total_values - unmatched AS matched, total_values >= 4 AND unmatched / total_values >= 0.5 AS contradicted FROM fit")
def vocabulary_fit(spark, sf):
    """Does the column hold the field's words at all?"""
    return V.vocabulary_fit(_values(spark, sf)).select("field", "total_values", "unmatched", "matched", "contradicted")


@query(f"""WITH {_FIT} SELECT w.field, w.value, w.n AS affected_rows FROM words w JOIN fit f USING (field)
  WHERE w.top < 90 AND NOT (f.total_values >= 4 AND f.unmatched / f.total_values >= 0.5)""")
def unknown_vocabulary(spark, sf):
    """What is still to be asked, once per value."""
    fit = _values(spark, sf)
    return V.unknown_values(fit, V.vocabulary_fit(fit)).select("field", "value", "affected_rows")


_CLEAN_SEG = f"""WITH {_WORDS} SELECT v._pos AS pos, coalesce(CASE WHEN w.top >= 90 THEN w.best END, '') AS segment,
  w.value IS NOT NULL AND w.top < 90 AS asked FROM vals v LEFT JOIN words w ON v.field = w.field AND v.value = w.value WHERE v.field = 'segment'"""


@query(_CLEAN_SEG)
def clean_rows(spark, sf):
    """Decided words applied to every row in one projection."""
    source = {"seg": from_table(derive(spark, sf, "segments"), "seg", "_pos")}
    vf = OP.value_frequency(source)
    out = C.clean(source, _accept("seg", [("segment", "segment")]), SEGMENT, vf)
    return out.rows.select(F.col("_ord").alias("pos"), "segment", F.array_contains("_waiting", "segment").alias("asked"))
