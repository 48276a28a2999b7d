"""Inputs the queries run on: the given tables, or tables derived from them.

A derivation is one SQL text that both engines read the same way, so a query and
its oracle start from identical rows.  ``{customer}`` etc. name the given tables.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
          "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def sql(spark: SparkSession, sf: str, text: str) -> DataFrame:
    used = {t for t in TABLES if "{" + t + "}" in text}
    return spark.sql(text.replace('"', "`"), **{t: table(spark, sf, t) for t in used})


def derive(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return sql(spark, sf, DERIVED[name])


def plain(text: str) -> str:
    """The same text for an engine that has the tables as views."""
    return re.sub(r"\{(\w+)\}", r"\1", text)


def ctes(*names: str) -> str:
    return ", ".join(f"{n} AS ({plain(DERIVED[n])})" for n in names)


_PAD = "lpad(CAST({0} AS STRING), {1}, '0')"


def pad(expr: str, n: int) -> str:
    return _PAD.format(f"({expr})", n)


_MONTH = ("CASE month(o_orderdate) " + " ".join(
    f"WHEN {i} THEN '{m}'" for i, m in enumerate(("Jan", "February", "mar", "Apr", "May", "JUNE", "Jul", "Aug", "Sept", "Oct", "Nov", "December"), 1)) + " END")
_D, _M, _Y = pad("day(o_orderdate)", 2), pad("month(o_orderdate)", 2), pad("year(o_orderdate)", 4)
_LAST = ("CASE (c_custkey * 7 + c_nationkey) % 16 WHEN 0 THEN 'Krishnamurthy' WHEN 1 THEN 'krishnamurty' WHEN 2 THEN 'Venkataraman' "
         "WHEN 3 THEN 'VENKATRAMAN' WHEN 4 THEN 'Sharma' WHEN 5 THEN 'Sharme' WHEN 6 THEN 'Qureshi' WHEN 7 THEN 'qu' WHEN 8 THEN 'Subramaniam' "
         "WHEN 9 THEN 'Subramanian' WHEN 10 THEN 'Iyer' WHEN 11 THEN 'iyer' WHEN 12 THEN 'Mukhopadhyay' WHEN 13 THEN 'Mukhopadhay' "
         "WHEN 14 THEN '' ELSE 'Bo' END")

DERIVED = {
    # a messy export of people: one per customer
    "people": f"""
SELECT c_custkey AS id,
  CASE WHEN c_custkey % 11 = 0 THEN '' ELSE 'E' || {pad('c_custkey', 7)} END AS employee_code,
  CASE c_custkey % 5 WHEN 0 THEN '  aarav ' WHEN 1 THEN 'DIYA' WHEN 2 THEN 'Rohan' WHEN 3 THEN 'McAnna' ELSE 'mary   JANE O''Brien' END AS first_name,
  {_LAST} AS last_name,
  CASE c_custkey % 7 WHEN 0 THEN 'USER' || CAST(c_custkey AS STRING) || '@Example.COM' WHEN 1 THEN 'not-an-email'
    WHEN 2 THEN '' ELSE 'user' || CAST(c_custkey AS STRING) || '@example.com ' END AS work_email,
  CASE c_custkey % 4 WHEN 0 THEN '+91 (98) ' || {pad('c_custkey % 100000000', 8)} WHEN 1 THEN '98-' || {pad('c_custkey % 100000000', 8)}
    WHEN 2 THEN '12' ELSE '' END AS phone,
  {pad('1950 + c_custkey % 60', 4)} || '-' || {pad('c_custkey % 12 + 1', 2)} || '-' || {pad('c_custkey % 28 + 1', 2)} AS date_of_birth,
  {pad('1990 + c_custkey % 33', 4)} || '-' || {pad('c_nationkey % 12 + 1', 2)} || '-' || {pad('c_nationkey % 28 + 1', 2)} AS date_of_joining,
  CASE WHEN c_custkey % 6 = 0 THEN {pad('1988 + c_custkey % 40', 4)} || '-06-30' ELSE '' END AS date_of_exit,
  CASE c_mktsegment WHEN 'BUILDING' THEN 'Engineering' WHEN 'MACHINERY' THEN 'Sales' WHEN 'FURNITURE' THEN 'Finanse'
    WHEN 'HOUSEHOLD' THEN '' ELSE 'Legal' END AS department,
  CASE c_custkey % 3 WHEN 0 THEN 'abcde' || {pad('c_custkey % 10000', 4)} || 'f' WHEN 1 THEN 'ABCDE ' || {pad('c_custkey % 10000', 4)} || '-F' ELSE 'BAD' END AS pan,
  CASE c_custkey % 3 WHEN 0 THEN '1000 ' || {pad('c_custkey % 100000000', 8)} WHEN 1 THEN 'none' ELSE '12345' END AS uan,
  CASE c_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'Active' WHEN 2 THEN 'Inactive' ELSE 'Gone' END AS status
FROM {{customer}}""",
    # the same people, cleaned, as two exports that share some identifiers
    "exports": f"""
SELECT 'hris.csv' AS _file, c_custkey AS _ord, 'hris.csv#' || CAST(c_custkey + 2 AS STRING) AS _source,
  CASE WHEN c_custkey % 5 = 0 THEN '' ELSE 'C' || CAST(c_custkey AS STRING) END AS employee_code,
  CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'm' || CAST(c_custkey - c_custkey % 4 AS STRING) || '@x.com' END AS work_email,
  CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE '' END AS full_name,
  c_mktsegment AS segment, '' AS balance
FROM {{customer}}
UNION ALL
SELECT 'payroll.csv' AS _file, 1000000000000 + c_custkey AS _ord, 'payroll.csv#' || CAST(c_custkey + 2 AS STRING) AS _source,
  'c' || CAST(c_custkey AS STRING) AS employee_code,
  CASE WHEN c_custkey % 7 = 0 THEN '' ELSE 'B' || CAST(c_custkey - c_custkey % 2 AS STRING) || '@x.com' END AS work_email,
  c_name AS full_name,
  CASE WHEN c_custkey % 4 = 0 THEN 'OTHER' ELSE '' END AS segment, CAST(c_nationkey AS STRING) AS balance
FROM {{customer}}""",
    # records ready for near-duplicate search
    "named": f"""
SELECT 'r' || CAST(c_custkey AS STRING) AS _rid, 'K' || {pad('c_custkey', 7)} AS key, c_custkey AS _seq,
  CASE c_custkey % 3 WHEN 0 THEN 'a.csv' WHEN 1 THEN 'b.csv' ELSE 'c.csv' END AS file,
  CASE WHEN c_custkey % 97 = 0 THEN '' ELSE '19' || {pad('60 + c_nationkey', 2)} || '-01-' || {pad('length(c_mktsegment)', 2)} END AS date_of_birth,
  CASE c_custkey % 2 WHEN 0 THEN 'Asha' ELSE ' ravi' END AS first_name,
  {_LAST} AS last_name,
  CASE WHEN c_custkey % 4 = 0 THEN 'P' || CAST(c_nationkey AS STRING) ELSE '' END AS pan
FROM {{customer}}""",
    "full_names": f"""
SELECT c_custkey AS id, c_custkey AS _pos,
  CASE c_custkey % 12 WHEN 0 THEN 'Sharma, Aarav  K' WHEN 1 THEN 'van der Berg, Jan' WHEN 2 THEN 'Jan van der Berg' WHEN 3 THEN 'John Smith Jr.'
    WHEN 4 THEN '' WHEN 5 THEN '  Madonna ' WHEN 6 THEN 'Adinolfi,' WHEN 7 THEN 'Mary Jane Watson' WHEN 8 THEN 'John Smith PhD. III'
    WHEN 9 THEN 'Jr Sr' WHEN 10 THEN 'de la Cruz' ELSE 'Ana de los Rios ' || CAST(c_nationkey AS STRING) END AS full_name
FROM {{customer}}""",
    "order_dates": f"""
SELECT o_orderkey, CASE o_orderkey % 10
  WHEN 0 THEN {_D} || '/' || {_M} || '/' || {_Y} WHEN 1 THEN {_M} || '/' || {_D} || '/' || {_Y} WHEN 2 THEN {_Y} || '-' || {_M} || '-' || {_D}
  WHEN 3 THEN {_D} || ' ' || {_MONTH} || ' ' || {_Y} WHEN 4 THEN {_MONTH} || ' ' || {_D} || ', ' || {_Y}
  WHEN 5 THEN {_D} || '.' || {_M} || '.' || substring({_Y}, 3, 2) WHEN 6 THEN '31/02/' || {_Y} WHEN 7 THEN '45/99/' || {_Y}
  WHEN 8 THEN {_D} || '/' || {_M} || '-' || {_Y} ELSE '' END AS text
FROM {{orders}}""",
    "date_columns": f"""
SELECT o_orderkey AS _pos,
  {_D} || '/' || {_M} || '/' || {_Y} AS day_first, {_M} || '-' || {_D} || '-' || {_Y} AS month_first, {_Y} || '-' || {_M} || '-' || {_D} AS iso,
  {pad('day(o_orderdate) % 12 + 1', 2)} || '/' || {_M} || '/' || {_Y} AS unclear,
  CASE WHEN o_orderkey % 3 = 0 THEN {_D} || '/' || {_M} || '/' || {_Y} ELSE {_M} || '/' || {_D} || '/' || {_Y} END AS mixed,
  CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE 'n/a' END AS unreadable
FROM {{orders}}""",
    "id_columns": f"""
SELECT c_custkey AS _pos, 'ABCDE' || {pad('c_custkey % 10000', 4)} || 'F' AS tax_ref,
  {pad('c_custkey % 10000', 4)} || ' 5678 ' || {pad('c_nationkey', 4)} AS ref_a, '1000' || {pad('c_custkey % 100000000', 8)} AS ref_b,
  '50100' || {pad('c_custkey % 1000000000', 9)} AS ref_c, c_name AS uid_text, c_mktsegment AS segment,
  CASE WHEN c_custkey % 2 = 0 THEN 'NULL' ELSE CAST(c_acctbal AS STRING) END AS balance
FROM {{customer}}""",
    "segments": f"""
SELECT c_custkey AS _pos, CASE c_custkey % 9
  WHEN 0 THEN lower(c_mktsegment) WHEN 1 THEN c_mktsegment || 'S' WHEN 2 THEN substring(c_mktsegment, 1, 5) WHEN 3 THEN '  ' || c_mktsegment
  WHEN 4 THEN 'cars' WHEN 5 THEN 'homes' WHEN 6 THEN 'gadgets' WHEN 7 THEN '' ELSE c_mktsegment END AS segment,
  CASE c_nationkey % 6 WHEN 0 THEN 'zebra' || CAST(c_custkey % 3 AS STRING) WHEN 1 THEN 'widgets' WHEN 2 THEN 'gizmos' WHEN 3 THEN 'sprockets'
  WHEN 4 THEN 'building' ELSE 'household' END AS other
FROM {{customer}}""",
    "reports": f"""
SELECT c_custkey AS _seq, 'r' || CAST(c_custkey AS STRING) AS _rid, 'K' || CAST(c_custkey AS STRING) AS key,
  'M' || CAST(c_custkey AS STRING) || '@x.com' AS work_email,
  CASE WHEN c_custkey % 30 = 4 THEN '' WHEN c_custkey % 20 = 7 THEN 'm' || CAST(c_custkey AS STRING) || '@x.com'
    WHEN c_custkey % 50 >= 45 THEN 'm' || CAST(c_custkey - 40 AS STRING) || '@x.com'
    WHEN c_custkey % 50 = 13 THEN ' gone' || CAST(c_nationkey AS STRING) || '@X.com'
    ELSE 'm' || CAST(c_custkey - c_custkey % 10 + (c_custkey * 3 + 1) % 10 AS STRING) || '@x.com ' END AS manager_email
FROM {{customer}}""",
    # the state of records after an analysis and a push
    "pushed": f"""
SELECT c_custkey AS _seq, 'r' || CAST(c_custkey AS STRING) AS _rid, 'K' || CAST(c_custkey AS STRING) AS key,
  CASE WHEN c_custkey % 13 = 0 THEN '' ELSE 'C' || CAST(c_custkey AS STRING) END AS employee_code, c_name AS full_name, c_mktsegment AS segment,
  CASE c_custkey % 6 WHEN 0 THEN 'success' WHEN 1 THEN 'pending' WHEN 2 THEN 'failed' WHEN 3 THEN 'rejected' WHEN 4 THEN 'skipped' ELSE 'rolled_back' END AS push_status,
  CASE WHEN c_custkey % 6 = 0 THEN 'TGT-' || CAST(c_custkey AS STRING) ELSE '' END AS push_detail,
  CASE WHEN c_nationkey % 5 = 0 THEN 'segment is off' ELSE '' END AS problem,
  CAST(CASE WHEN c_nationkey % 4 = 1 THEN c_nationkey % 3 ELSE 0 END AS BIGINT) AS n_blocks,
  CAST(CASE WHEN c_custkey % 3 = 0 THEN 2 ELSE 1 END AS BIGINT) AS n_sources
FROM {{customer}}""",
    "mappings": f"""
SELECT p_brand AS file, p_name || '_' || CAST(p_partkey AS STRING) AS "column",
  CASE WHEN p_size % 3 = 0 THEN 'segment' WHEN p_size % 3 = 1 THEN 'full_name' ELSE NULL END AS target_field,
  CASE p_partkey % 4 WHEN 0 THEN 'auto' WHEN 1 THEN 'flagged' WHEN 2 THEN 'escalated' ELSE 'ignored' END AS disposition,
  CASE p_partkey % 3 WHEN 0 THEN 'human' WHEN 1 THEN 'scored' ELSE 'memory' END AS provenance, p_type AS reason, CAST(NULL AS STRING) AS transform
FROM {{part}}""",
    # events read as an audit trail
    "trail": f"""
SELECT event_id AS id, CAST(ts AS STRING) AS at, CASE event_type WHEN 'signup' THEN 'human' WHEN 'error' THEN 'system' ELSE 'agent' END AS actor,
  CASE event_type WHEN 'click' THEN 'canonicalise_value' WHEN 'view' THEN 'repair_value' WHEN 'purchase' THEN 'normalise_values' ELSE event_type END AS action,
  CASE WHEN event_type = 'purchase' THEN 'column:f:' || CAST(user_id AS STRING) WHEN user_id % 2 = 0 THEN 'K' || CAST(user_id AS STRING)
    ELSE 'src#' || CAST(user_id AS STRING) END AS entity,
  props AS before, CAST(CAST(event_id % 7 AS BIGINT) AS STRING) AS after, 'because ' || event_type AS rationale
FROM {{events}}""",
}
