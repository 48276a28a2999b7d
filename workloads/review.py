"""Queries over records after an analysis: checks, questions, loads, plans, recipes."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from loomfold.lineage import cut, scratch
from loomfold.operators import answers as A, judge as J, load as L, match as M, review as W, validate as V
from loomfold.plans import plan as P, questions as Q, recipe as RC
from loomfold.plans.run import run
from loomfold.sources.export import export_frame
from loomfold.sources.store import RunStore
from loomfold.sources.tables import from_table
from loomfold.specs.employee import EMPLOYEE
from loomfold.streaming.apply import checked, drain
from workloads.inputs import DERIVED, ctes, derive, plain, sql, table
from workloads.specs import PARTY, PERSON

QUERIES, ORACLE = {}, {}


def query(oracle: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if oracle is not None:
            ORACLE[fn.__name__] = oracle
        return fn
    return register


# -- P5, P12, P13, A9 --------------------------------------------------------

_FIELDS = ("employee_code", "first_name", "last_name", "work_email", "phone", "date_of_birth", "date_of_joining", "date_of_exit", "department", "pan", "uan", "status")
_FORMAT_SQL = {"work_email": "^[^@\\s]+@[^@\\s]+\\.[A-Za-z]{2,}$", "phone": "^\\+?\\d[\\d\\s\\-()]{7,17}\\d$", "pan": "^[A-Z]{5}[0-9]{4}[A-Z]$", "uan": "^\\d{12}$"}


def _date(c: str) -> str:
    return f"CAST(try_strptime(substring({c}, 1, 10), '%Y-%m-%d') AS DATE)"


def _issues_sql(source: str) -> str:
    out = []
    for f in ("employee_code", "first_name", "last_name", "work_email", "date_of_birth", "date_of_joining", "department", "status"):
        out.append((f"trim({f}) = ''", f, "required"))
    for f, p in _FORMAT_SQL.items():
        out.append((f"trim({f}) <> '' AND NOT regexp_matches(trim({f}), '{p}')", f, "format"))
    out.append(("trim(department) <> '' AND trim(department) NOT IN ('Engineering', 'Sales', 'Finance', 'Legal')", "department", "enum"))
    out.append(("trim(status) <> '' AND trim(status) NOT IN ('Active', 'Inactive')", "status", "enum"))
    out.append(("len(trim(employee_code)) > 7", "employee_code", "length"))
    born, start, end = _date("date_of_birth"), _date("date_of_joining"), _date("date_of_exit")
    age = f"date_diff('day', {born}, {start}) / 365.25"
    out.append((f"{start} <= {born}", "date_of_joining", "order"))
    out.append((f"{start} > {born} AND NOT ({age} BETWEEN 15 AND 75)", "date_of_joining", "age"))
    out.append((f"{end} < {start}", "date_of_exit", "order"))
    out.append((f"trim(status) = 'Inactive' AND {end} IS NULL", "status", "exit"))
    return " UNION ALL ".join(f"SELECT id, '{f}' AS field, '{r}' AS rule FROM {source} WHERE {c}" for c, f, r in out)


@query(f"WITH {ctes('people')} {_issues_sql('people')}")
def validate_rows(spark, sf):
    """P5: one narrow projection, issues exploded."""
    people = V.issues_of(derive(spark, sf, "people"), PERSON)
    return people.select("id", F.inline("issues")).select("id", "field", "rule")


_FIXED = """f AS (SELECT p.*, CASE WHEN bad AND regexp_replace(upper(pan), '[ -]', '', 'g') <> '' THEN regexp_replace(upper(pan), '[ -]', '', 'g') ELSE pan END AS pan2,
    CASE WHEN bad AND regexp_replace(uan, '\\D', '', 'g') <> '' THEN regexp_replace(uan, '\\D', '', 'g') ELSE uan END AS uan2,
    CASE WHEN bad AND trim(status) = '' THEN 'Active' WHEN bad AND status = 'Active' AND """ + _date("date_of_exit") + """ IS NOT NULL THEN 'Inactive' ELSE status END AS status2
    FROM (SELECT *, id IN (SELECT id FROM i1) AS bad FROM people) p),
  fixed AS (SELECT id, employee_code, first_name, last_name, work_email, phone, date_of_birth, date_of_joining, date_of_exit, department, pan2 AS pan, uan2 AS uan, status2 AS status FROM f)"""


@query(f"""WITH {ctes('people')}, i1 AS ({_issues_sql('people')}), {_FIXED}, i2 AS ({_issues_sql('fixed')}), n AS (SELECT id, count(*) AS n FROM i2 GROUP BY id)
  SELECT f.id, pan2 AS pan, uan2 AS uan, status2 AS status, CASE WHEN pan2 <> pan THEN 1 ELSE 0 END + CASE WHEN uan2 <> uan THEN 1 ELSE 0 END + CASE WHEN status2 <> status THEN 1 ELSE 0 END AS changed,
    coalesce(n.n, 0) AS issues_left FROM f LEFT JOIN n USING (id)""")
def repair_rows(spark, sf):
    """Failing records are repaired once and checked again, in one stage."""
    out = V.validate_and_repair(derive(spark, sf, "people"), PERSON)
    return out.select("id", "pan", "uan", "status", F.size("changes").alias("changed"), F.size("issues").alias("issues_left"))


@query(f"""WITH {ctes('people')}, i1 AS ({_issues_sql('people')}), {_FIXED}, c AS (SELECT id, 'pan' AS field, pan AS b, pan2 AS a FROM f WHERE pan2 <> pan UNION ALL SELECT id, 'uan', uan, uan2 FROM f WHERE uan2 <> uan
    UNION ALL SELECT id, 'status', status, status2 FROM f WHERE status2 <> status)
  SELECT id, field, CASE WHEN field = 'status' THEN b WHEN len(trim(b)) <= 4 THEN repeat('*', len(trim(b))) ELSE repeat('*', len(trim(b)) - 4) || right(trim(b), 4) END AS before,
    CASE WHEN field = 'status' THEN a WHEN len(a) <= 4 THEN repeat('*', len(a)) ELSE repeat('*', len(a) - 4) || right(a, 4) END AS after FROM c""")
def repair_audit(spark, sf):
    """U: repairs as audit rows, personal values masked."""
    out = V.validate_and_repair(derive(spark, sf, "people").withColumn("key", F.col("id")), PERSON)
    return V.repair_audit(out, PERSON).select(F.col("key").alias("id"), "field", "before", "after")


@query(f"""WITH {ctes('people')}, t AS (SELECT count(*) AS total FROM people), m AS ({" UNION ALL ".join(
    f"SELECT '{f}' AS field, count(CASE WHEN trim({f}) = '' THEN 1 END) AS missing FROM people" for f in ("employee_code", "first_name", "last_name", "work_email", "date_of_birth", "date_of_joining", "status"))})
  SELECT field, missing, total, total >= 10 AND missing / total >= 0.9 AS structural FROM m, t""")
def missing_required(spark, sf):
    """One global aggregate; a field under question is left out."""
    return V.missing_required(derive(spark, sf, "people"), PERSON, pending={"department"})


@query(f"""WITH {ctes('people')} SELECT id, CASE WHEN trim(department) = '' THEN 'skipped' ELSE 'pending' END AS push_status FROM people""")
def answered_fields(spark, sf):
    """A10: "skip every record without it" as one conditional update."""
    records = derive(spark, sf, "people").withColumn("push_status", F.lit("pending"))
    return V.apply_field_answers(records, ["department", "work_email"], {"field:department": "skip_records", "field:work_email": "not_required"})[0].select("id", "push_status")


# -- J11, J12, J14 -----------------------------------------------------------

_EDITS = """SELECT (CASE WHEN o_orderkey % 4 = 0 THEN 'push:K' ELSE 'record:K' END) || CAST(o_custkey AS STRING) AS subject,
  CASE WHEN max(o_orderkey) % 3 = 0 THEN 'value' ELSE 'edit' END AS action, CASE WHEN max(o_orderkey) % 3 = 0 THEN 'skip' END AS value,
  CASE WHEN max(o_orderkey) % 3 <> 0 THEN 'N' || CAST(max(o_orderkey) AS STRING) END AS code FROM {orders} GROUP BY 1, o_custkey"""


@query(f"""WITH {ctes('pushed')}, e AS ({plain(_EDITS)}), k AS (SELECT split_part(subject, ':', 2) AS key, arg_max(action, starts_with(subject, 'push')) AS action,
    arg_max(coalesce(code, ''), starts_with(subject, 'push')) AS code FROM e GROUP BY 1)
  SELECT CASE WHEN k.action = 'edit' AND k.code <> p.employee_code THEN k.code ELSE p.key END AS key, CASE WHEN k.action = 'edit' THEN k.code ELSE p.employee_code END AS employee_code,
    CASE WHEN k.action = 'value' THEN 'skipped' WHEN k.action = 'edit' THEN 'pending' ELSE p.push_status END AS push_status FROM pushed p LEFT JOIN k USING (key)""")
def record_edits(spark, sf):
    """Corrections and skips; an answer after a push outranks the earlier one."""
    said = sql(spark, sf, _EDITS).select("subject", "action", "value", F.when(F.col("code").isNotNull(), F.create_map(F.lit("employee_code"), F.col("code"))).alias("fields"))
    records = _party(derive(spark, sf, "pushed"))
    return V.record_edits(records, said, PARTY)[0].select("key", "employee_code", "push_status")


def _party(df):
    for n in PARTY.names:
        if n not in df.columns:
            df = df.withColumn(n, F.lit(""))
    issue = F.struct(F.lit("segment").alias("field"), F.lit("enum").alias("rule"), F.col("problem").alias("message"))
    return df.withColumn("issues", F.array_compact(F.array(F.when(F.col("problem") != "", issue))))


@query(f"""WITH {ctes('reports')}, a AS (SELECT DISTINCT trim(lower(manager_email)) AS m FROM reports WHERE trim(lower(manager_email)) LIKE 'gone%')
  SELECT key, CASE WHEN _seq % 9 = 0 THEN '' WHEN a.m IS NULL THEN manager_email WHEN len(a.m) % 2 = 0 THEN '' ELSE 'new' || a.m END AS manager_email
  FROM reports LEFT JOIN a ON a.m = trim(lower(manager_email))""")
def reference_answers(spark, sf):
    """Clear, reassign, cut a cycle."""
    reports = derive(spark, sf, "reports")
    m = F.lower(F.trim("manager_email"))
    gone = reports.select(m.alias("m")).where("m LIKE 'gone%'").distinct().select(
        F.concat(F.lit("manager:"), "m").alias("subject"), F.lit("value").alias("action"),
        F.when(F.length("m") % 2 == 0, F.lit("clear")).otherwise(F.concat(F.lit("reassign:new"), "m")).alias("value"), F.lit(None).cast("map<string,string>").alias("fields"))
    cuts = reports.where("_seq % 9 = 0").select(F.concat(F.lit("cycle-clear:"), "key").alias("subject"), F.lit("value").alias("action"), F.lit("true").alias("value"),
                                               F.lit(None).cast("map<string,string>").alias("fields"))
    return V.reference_answers(reports, gone.unionByName(cuts), "manager_email").select("key", "manager_email")


@query(f"""WITH {ctes('pushed')} SELECT key, CASE WHEN push_status IN ('success', 'rolled_back') THEN push_status ELSE 'pending' END AS push_status,
  CASE WHEN push_status IN ('success', 'rolled_back') THEN push_detail ELSE '' END AS push_detail FROM pushed""")
def carried_status(spark, sf):
    """J14."""
    before = derive(spark, sf, "pushed")
    fresh = before.withColumns({"push_status": F.lit("pending"), "push_detail": F.lit("")})
    return L.carry_status(fresh, before).select("key", "push_status", "push_detail")


# -- A11, A12, T3, J6, J7 ----------------------------------------------------

@query(f"""WITH {ctes('mappings')}, a AS (SELECT count(*) AS columns, count(CASE WHEN target_field IS NOT NULL AND disposition IN ('auto', 'flagged') THEN 1 END) AS mapped,
    count(DISTINCT CASE WHEN target_field IN ('employee_code', 'full_name') AND disposition IN ('auto', 'flagged') THEN target_field END) AS required_found FROM mappings)
  SELECT columns, mapped, round(mapped / columns, 6) AS coverage, required_found, 2 AS required_total, mapped / columns < 0.35 AND required_found / 2 < 0.5 AS stop FROM a""")
def coverage(spark, sf):
    """A11."""
    return J.mapping_coverage(derive(spark, sf, "mappings"), PARTY).withColumn("coverage", F.round("coverage", 6))


_QUEUE = """SELECT 'q' || CAST(s_suppkey AS STRING) AS subject, CASE s_suppkey % 4 WHEN 0 THEN 'column_mapping' WHEN 1 THEN 'validation_failed' WHEN 2 THEN 'duplicate_suspected' ELSE 'enum_value' END AS type,
  CASE s_nationkey % 3 WHEN 0 THEN 'segment' WHEN 1 THEN 'full_name' END AS field FROM {supplier}"""
_REFS = """SELECT DISTINCT 'q' || CAST(l_suppkey AS STRING) AS subject, CASE WHEN l_orderkey % 2 = 0 THEN 'orders#' || CAST(l_orderkey AS STRING) ELSE 'K' || CAST(l_partkey AS STRING) END AS ref FROM {lineitem}"""


@query(f"""WITH q AS ({plain(_QUEUE)}), r AS ({plain(_REFS)}), b AS (SELECT count(DISTINCT ref) AS blocked FROM r WHERE subject IN (SELECT subject FROM q WHERE type IN ('validation_failed', 'duplicate_suspected'))),
  n AS (SELECT count(*) AS questions FROM q), t AS (SELECT count(*) AS records FROM customer)
  SELECT blocked, questions, records, CASE WHEN questions >= 40 THEN 'absolute' WHEN records >= 8 AND questions >= 12 AND blocked / records >= 0.25 THEN 'rate' END AS tripped FROM b, n, t""")
def breaker(spark, sf):
    """Distinct blocked records over record-level questions."""
    total = table(spark, sf, "customer").agg(F.count(F.lit(1)).alias("n"))
    return J.batch_rate(sql(spark, sf, _QUEUE), sql(spark, sf, _REFS), total)


_LINKS = f"""q AS ({plain(_QUEUE)}), r AS ({plain(_REFS)}), l AS (SELECT DISTINCT subject, 'K' || CAST(o_custkey AS VARCHAR) AS record FROM r JOIN orders ON ref = 'orders#' || CAST(o_orderkey AS VARCHAR)
  UNION SELECT subject, ref FROM r JOIN customer ON ref = 'K' || CAST(c_custkey AS VARCHAR))"""


def _links(spark, sf):
    members = table(spark, sf, "orders").select(F.concat(F.lit("orders#"), F.col("o_orderkey").cast("string")).alias("_source"), F.concat(F.lit("K"), F.col("o_custkey").cast("string")).alias("_rid"))
    key = F.concat(F.lit("K"), F.col("c_custkey").cast("string"))
    return J.link_refs(sql(spark, sf, _REFS), members, table(spark, sf, "customer").select(key.alias("key"), key.alias("_rid")))


@query(f"WITH {_LINKS}, n AS (SELECT record, count(DISTINCT subject) AS n_blocks FROM l GROUP BY record), w AS (SELECT record, string_agg(DISTINCT field, ',' ORDER BY field) AS waiting FROM l JOIN q USING (subject) WHERE field IS NOT NULL GROUP BY record) "
       "SELECT n.record, n.n_blocks, w.waiting FROM n LEFT JOIN w USING (record)")
def link_questions(spark, sf):
    """References are source rows first, keys otherwise."""
    links = cut(_links(spark, sf))
    waits = J.fields_under_question(links, sql(spark, sf, _QUEUE))
    return J.block_counts(links).join(waits, "_rid", "left").select(F.col("_rid").alias("record"), "n_blocks", F.array_join("waiting", ",").alias("waiting"))


_CARDS = """SELECT CASE WHEN p_partkey % 10 = 0 THEN 'contest:' || p_brand || ':f' || CAST(p_partkey AS STRING) ELSE 'map:' || p_brand || ':' || p_name || CAST(p_partkey AS STRING) END AS subject,
  CASE WHEN p_partkey % 7 = 0 THEN 'enum_value' ELSE 'column_mapping' END AS type, p_brand AS file, CASE WHEN p_size % 2 = 0 THEN upper(replace(p_name, ' ', '_')) ELSE p_name END AS "column", p_partkey AS pos FROM {part}"""


@query(f"""WITH c AS ({plain(_CARDS)}), p AS (SELECT * FROM c WHERE type = 'column_mapping' AND NOT starts_with(subject, 'contest:')),
  g AS (SELECT arg_min(subject, pos) AS subject, list(file ORDER BY pos) AS files FROM p GROUP BY replace(lower("column"), '_', ' '))
  SELECT subject, array_to_string(files[2:], ',') AS also_in FROM g UNION ALL SELECT subject, '' FROM c WHERE NOT (type = 'column_mapping' AND NOT starts_with(subject, 'contest:'))""")
def dedupe_questions(spark, sf):
    """One question per header."""
    return J.one_per_column_name(sql(spark, sf, _CARDS), ["pos"]).select("subject", F.array_join("also_in", ",").alias("also_in"))


_CAND = "transform(sequence(0, 3), i -> named_struct('field', concat('f', cast((p_partkey + i) % 5 as string)), 'score', 0.9 - i / 10.0, 'embedding_score', 0.0, 'fuzzy_score', 0.0))"


@query("""WITH e AS (SELECT p_partkey, p_size FROM part WHERE p_partkey % 4 = 2 ) SELECT DISTINCT 'f' || CAST((p_partkey + i) % 5 AS VARCHAR) AS field FROM e, (SELECT unnest([0, 1]) AS i) WHERE i = 0 OR p_size % 2 = 0""")
def pending_fields(spark, sf):
    """Fields of columns still in question; the runner-up too where they tie."""
    maps = table(spark, sf, "part").select(F.when(F.col("p_partkey") % 4 == 2, "escalated").otherwise("auto").alias("disposition"),
                                                              F.when(F.col("p_size") % 2 == 0, 0.05).otherwise(0.3).alias("margin"), F.expr(_CAND).alias("candidates"))
    return M.pending_fields(maps)


# -- loading -----------------------------------------------------------------

_BATCH = """SELECT 'O' || CAST(o_orderkey AS STRING) AS key, CASE WHEN o_custkey % 17 = 0 THEN ' ' ELSE 'C' || CAST(o_custkey AS STRING) END AS code, o_orderkey AS _seq,
  CASE WHEN o_orderkey % 5 = 0 THEN 'x:' ELSE 'run:' END || CAST(o_custkey AS STRING) AS idempotency FROM {orders}"""
_TARGET = """SELECT CASE WHEN c_custkey % 4 = 1 THEN 'old' ELSE 'C' END || CAST(c_custkey AS STRING) AS code, 'T' || CAST(c_custkey AS STRING) AS target_id,
  CASE WHEN c_custkey % 4 = 1 THEN 'run:' || CAST(c_custkey AS STRING) END AS idempotency FROM {customer} WHERE c_custkey % 2 = 1"""
_OUTCOME = f"""b AS ({plain(_BATCH)}), t AS ({plain(_TARGET)}), d AS (SELECT idempotency, min(target_id) AS done FROM t WHERE idempotency IS NOT NULL GROUP BY 1),
  f AS (SELECT trim(code) AS code, min(_seq) AS s, arg_min(idempotency, _seq) AS i FROM b WHERE trim(code) <> '' GROUP BY 1),
  o AS (SELECT b.key, trim(b.code) AS code, CASE WHEN trim(b.code) = '' THEN 422 WHEN d.done IS NOT NULL THEN 200 WHEN trim(b.code) IN (SELECT code FROM t) THEN 409
    WHEN b._seq = f.s THEN 201 WHEN b.idempotency = f.i THEN 200 ELSE 409 END AS status FROM b LEFT JOIN d USING (idempotency) LEFT JOIN f ON f.code = trim(b.code))"""


@query(f"WITH {_OUTCOME} SELECT key, code, status, CASE WHEN status < 400 THEN 'success' ELSE 'rejected' END AS outcome FROM o")
def load_outcomes(spark, sf):
    """Create, replay or refuse, as joins against the target table."""
    return L.load_into_table(sql(spark, sf, _BATCH), sql(spark, sf, _TARGET))[0].select("key", "code", "status", "outcome")


@query(f"""WITH {_OUTCOME}, m AS (SELECT regexp_replace('code ' || code || ' already exists in the target', '\\b[A-Za-z]{{0,3}}\\d{{2,}}[A-Za-z0-9-]*\\b', '<code>', 'g') AS reason, count(*) AS n FROM o WHERE status = 409 GROUP BY 1
    UNION ALL SELECT 'code is required', count(*) FROM o WHERE status = 422 HAVING count(*) > 0),
  a AS (SELECT count(*) AS attempted, count(CASE WHEN status >= 400 THEN 1 END) AS rejected FROM o), top AS (SELECT reason, n FROM m ORDER BY n DESC, reason DESC LIMIT 1)
  SELECT attempted, rejected, reason, n AS reason_count, rejected >= 5 AND rejected / attempted >= 0.5 AND n / rejected >= 0.5 AS flood FROM a, top""")
def rejection_flood(spark, sf):
    """The leading reason once codes are set aside."""
    return L.rejection_flood(L.load_into_table(sql(spark, sf, _BATCH), sql(spark, sf, _TARGET))[0])


def _send(body: str, token: str):
    """A stand-in service: refuses, fails or accepts by the last digit of the token."""
    digit = int(token[-1])
    if digit == 3:
        return 409, {"error": f"code {json.loads(body)['employee_code']} exists"}
    return (503, {"error": "busy"}) if digit == 7 else (201, {"id": "T" + token})


@query("""SELECT 'K' || CAST(c_custkey AS VARCHAR) AS key, CASE c_custkey % 10 WHEN 3 THEN 409 WHEN 7 THEN 503 ELSE 201 END AS status, CASE WHEN c_custkey % 10 = 7 THEN 3 ELSE 1 END AS attempts,
  CASE c_custkey % 10 WHEN 3 THEN 'rejected' WHEN 7 THEN 'failed' ELSE 'success' END AS outcome,
  CASE c_custkey % 10 WHEN 3 THEN 'code C' || CAST(c_custkey AS VARCHAR) || ' exists' WHEN 7 THEN 'busy' END AS message FROM customer""")
def push_outcomes(spark, sf):
    """Records sent in parallel; outcomes written once."""
    batch = table(spark, sf, "customer").select(F.concat(F.lit("K"), F.col("c_custkey").cast("string")).alias("key"), F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("code"))
    batch = batch.withColumns({"idempotency": F.concat(F.lit("run:"), "code"), "payload": F.to_json(F.struct(F.col("code").alias("employee_code")))})
    return L.push(batch, _send, sleep=lambda _: None).select("key", "status", "attempts", "outcome", "message")


@query(f"""WITH {ctes('pushed')}, k AS (SELECT DISTINCT 'K' || CAST(o_custkey AS VARCHAR) AS key FROM orders WHERE o_orderkey % 2 = 0), g AS (SELECT key, CASE WHEN employee_code <> '' THEN employee_code ELSE key END AS code FROM pushed WHERE push_status = 'success' AND key IN (SELECT key FROM k))
  SELECT 'record' AS what, key AS name, CASE WHEN key IN (SELECT key FROM g) THEN 'rolled_back' ELSE push_status END AS state FROM pushed
  UNION ALL SELECT 'target', 'C' || CAST(c_custkey AS VARCHAR), 'kept' FROM customer WHERE 'C' || CAST(c_custkey AS VARCHAR) NOT IN (SELECT code FROM g)
  UNION ALL SELECT 'audit', key, 'rolled_back' FROM g""")
def rollback(spark, sf):
    """Only loaded records among the keys; the target loses exactly those rows."""
    keys = table(spark, sf, "orders").where("o_orderkey % 2 = 0").select(F.concat(F.lit("K"), F.col("o_custkey").cast("string")).alias("key"))
    target = table(spark, sf, "customer").select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("code"))
    records, left, audit = L.rollback(derive(spark, sf, "pushed"), keys, target, "wrong batch")
    return (records.select(F.lit("record").alias("what"), F.col("key").alias("name"), F.col("push_status").alias("state"))
            .unionByName(left.select(F.lit("target").alias("what"), F.col("code").alias("name"), F.lit("kept").alias("state")))
            .unionByName(audit.select(F.lit("audit").alias("what"), F.col("key").alias("name"), F.col("after").alias("state"))))


@query(f"""WITH {ctes('pushed')} SELECT key, 'all' AS which FROM pushed WHERE push_status = 'failed' UNION ALL
  SELECT key, 'named' FROM pushed WHERE push_status IN ('failed', 'rolled_back') AND key IN (SELECT 'K' || CAST(o_custkey AS VARCHAR) FROM orders WHERE o_orderkey % 3 = 0)""")
def retry_targets(spark, sf):
    """S11."""
    records = derive(spark, sf, "pushed")
    keys = table(spark, sf, "orders").where("o_orderkey % 3 = 0").select(F.concat(F.lit("K"), F.col("o_custkey").cast("string")).alias("key"))
    return (L.retry_targets(records).select("key", F.lit("all").alias("which")).unionByName(L.retry_targets(records, keys).select("key", F.lit("named").alias("which"))))


@query(f"WITH {ctes('pushed')} SELECT count(CASE WHEN push_status = 'success' THEN 1 END) AS pushed, count(CASE WHEN push_status = 'failed' THEN 1 END) AS push_failed, count(CASE WHEN push_status = 'rejected' THEN 1 END) AS push_rejected FROM pushed")
def push_totals(spark, sf):
    """A16."""
    return L.push_totals(derive(spark, sf, "pushed"))


# -- plan, export, recipe ----------------------------------------------------

_BUCKET = """CASE WHEN push_status IN ('success', 'skipped', 'rolled_back') THEN 'settled' WHEN problem = '' AND n_blocks = 0 AND push_status IN ('pending', 'failed') THEN 'will_send' ELSE 'held_back' END"""


@query(f"""WITH {ctes('pushed')} SELECT key, {_BUCKET} AS bucket, CASE WHEN push_status = 'success' THEN 'loaded into the target' WHEN push_status = 'rolled_back' THEN 'rolled back'
    WHEN n_blocks > 0 THEN 'waiting on ' || CAST(n_blocks AS VARCHAR) || ' open question(s)' WHEN problem <> '' THEN problem WHEN push_status = 'rejected' THEN 'refused by the target'
    WHEN push_status = 'skipped' THEN 'skipped on purpose' ELSE '' END AS reason_held FROM pushed""")
def plan_buckets(spark, sf):
    """P6, P7."""
    return P.build_plan(_party(derive(spark, sf, "pushed")), PARTY).select("key", "bucket", "reason_held")


_ACTIONS = "('canonicalise_value', 'repair_value', 'merge_duplicate', 'normalise_values')"
_CHANGES = f"""{ctes('pushed', 'trail')}, names AS (SELECT key AS record, key AS entity FROM pushed UNION SELECT key, 'src#' || CAST(_seq AS VARCHAR) FROM pushed),
  ch AS (SELECT record, action, t.after FROM trail t JOIN names USING (entity) WHERE action IN {_ACTIONS} AND entity NOT LIKE 'column:%')"""


def _changes(spark, sf):
    records = _party(derive(spark, sf, "pushed"))
    members = records.select("_rid", F.concat(F.lit("src#"), F.col("_seq").cast("string")).alias("_source"))
    return records, P.record_changes(derive(spark, sf, "trail"), members, records)


@query(f"WITH {_CHANGES} SELECT record, action, count(*) AS n FROM ch GROUP BY ALL")
def record_changes(spark, sf):
    """Edits found through any source row or the key."""
    records, changes = _changes(spark, sf)
    return changes.join(records.select("_rid", F.col("key").alias("record")), "_rid").groupBy("record", "action").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_CHANGES}, n AS (SELECT record, count(*) AS n FROM ch GROUP BY 1), p AS (SELECT {_BUCKET} AS bucket, push_status, coalesce(n.n, 0) AS n FROM pushed LEFT JOIN n ON n.record = pushed.key)
  SELECT count(CASE WHEN bucket = 'will_send' THEN 1 END) AS will_send, count(CASE WHEN bucket = 'held_back' THEN 1 END) AS held_back, count(CASE WHEN bucket = 'settled' THEN 1 END) AS settled,
    CAST(coalesce(sum(CASE WHEN bucket <> 'held_back' THEN n END), 0) AS BIGINT) AS fields_changed, count(CASE WHEN bucket <> 'held_back' AND n > 0 THEN 1 END) AS records_with_changes,
    count(CASE WHEN push_status = 'success' THEN 1 END) AS already_loaded FROM p""")
def plan_totals(spark, sf):
    """A21."""
    records, changes = _changes(spark, sf)
    return P.plan_totals(P.build_plan(records, PARTY, changes))


@query(f"""WITH {ctes('mappings')} SELECT target_field, string_agg(file || '.' || "column", ',' ORDER BY file || '.' || "column") AS origins, count(*) > 1 AS multi_source FROM mappings WHERE target_field IS NOT NULL GROUP BY 1""")
def field_origin(spark, sf):
    """A20."""
    return P.field_origin(derive(spark, sf, "mappings")).select("target_field", F.array_join("origins", ",").alias("origins"), "multi_source")


@query(f"""WITH {ctes('pushed')} SELECT employee_code, '' AS work_email, full_name, segment, '' AS balance, push_status AS migration_result, CASE WHEN push_status = 'success' THEN push_detail ELSE '' END AS target_id,
  CASE WHEN n_sources = 2 THEN key || '#1; ' || key || '#2' ELSE key || '#1' END AS source_rows FROM pushed""")
def export_rows(spark, sf):
    """S4."""
    both = F.when(F.col("n_sources") == 2, F.array(F.concat("key", F.lit("#1")), F.concat("key", F.lit("#2")))).otherwise(F.array(F.concat("key", F.lit("#1"))))
    return export_frame(_party(derive(spark, sf, "pushed")).withColumn("sources", both), PARTY)


@query(f"""WITH {ctes('pushed')} SELECT key, '{{' || CASE WHEN employee_code <> '' THEN '"employee_code":"' || employee_code || '",' ELSE '' END || '"full_name":"' || full_name || '","segment":"' || segment || '"}}' AS payload FROM pushed""")
def payloads(spark, sf):
    """Contract fields that hold a value."""
    return _party(derive(spark, sf, "pushed")).select("key", L.payload(PARTY).alias("payload"))


_WORDS = "SELECT CASE WHEN c_custkey % 3 = 0 THEN lower(c_mktsegment) ELSE c_mktsegment || 'S' END AS before, initcap_(c_mktsegment) AS after, c_custkey AS entity FROM {customer}".replace(
    "initcap_(c_mktsegment)", "upper(substring(c_mktsegment, 1, 1)) || lower(substring(c_mktsegment, 2))")


@query(f"""WITH w AS ({plain(_WORDS)}), a AS (SELECT lower(before) AS low, after, arg_min(before, entity) AS before, count(*) AS n FROM w GROUP BY 1, 2), h AS (SELECT 'machinerys' AS low, 'Machinery' AS after UNION ALL SELECT 'odd', '__blank__')
  SELECT before AS "from", after AS "to", 'automatic' AS how, n FROM a WHERE (low, after) NOT IN (SELECT low, after FROM h) UNION ALL
  SELECT low, CASE WHEN after = '__blank__' THEN '(blank)' ELSE after END, 'confirmed', 0 FROM h""")
def value_rules(spark, sf):
    """Distinct word pairs with row counts; a person's answer replaces the scored one."""
    said = A.answers_frame(spark, {"enum:segment:machinerys": "Machinery", "enum:segment:odd": "__blank__"})
    return RC.value_rules(sql(spark, sf, _WORDS), said).select("from", "to", "how", "n")


_GIVEN = """SELECT CASE p_partkey % 4 WHEN 0 THEN 'map:' || p_brand || ':c' WHEN 1 THEN 'enum:segment:w' WHEN 2 THEN 'record:' ELSE 'identity:a|' END || CAST(p_partkey AS STRING) AS subject,
  CASE p_partkey % 4 WHEN 3 THEN 'separate' ELSE p_name END AS value FROM {part}"""


@query(f"""WITH {ctes('mappings', 'trail')}, g AS ({plain(_GIVEN)}), w AS (SELECT lower(before) AS low, after FROM trail WHERE action = 'canonicalise_value' GROUP BY ALL)
  SELECT 'field_mapping' AS section, how, count(*) AS n FROM (SELECT CASE WHEN provenance IN ('human', 'memory') THEN 'confirmed' WHEN disposition = 'flagged' THEN 'inferred' ELSE 'automatic' END AS how FROM mappings WHERE target_field IS NOT NULL) GROUP BY how
  UNION ALL SELECT 'ignored_column', NULL, count(*) FROM mappings WHERE target_field IS NULL
  UNION ALL SELECT 'value_mapping', 'automatic', count(*) FROM w UNION ALL SELECT 'value_mapping', 'confirmed', count(*) FROM g WHERE starts_with(subject, 'enum')
  UNION ALL SELECT 'identity_rule', 'confirmed', count(*) FROM g WHERE starts_with(subject, 'identity')
  UNION ALL SELECT 'answers', 'value', count(*) FROM g WHERE starts_with(subject, 'map') OR starts_with(subject, 'enum')
  UNION ALL SELECT 'record_answers', 'value', count(*) FROM g WHERE starts_with(subject, 'record') OR starts_with(subject, 'identity')""")
def recipe_sections(spark, sf):
    """Every rule of a run as one table, nothing capped."""
    given = sql(spark, sf, _GIVEN).select("subject", F.lit("value").alias("action"), "value", F.lit(None).cast("map<string,string>").alias("fields"))
    recipe = RC.build_recipe(derive(spark, sf, "mappings"), derive(spark, sf, "trail"), given, PARTY, "run")
    return recipe.groupBy("section", "how").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH g AS ({plain(_GIVEN)}) SELECT subject, CASE WHEN subject = 'enum:segment:w1' THEN 'mine' ELSE value END AS value FROM g WHERE starts_with(subject, 'map') OR starts_with(subject, 'enum')""")
def recipe_replay(spark, sf):
    """Only answers come back; one already given stands."""
    given = sql(spark, sf, _GIVEN).select("subject", F.lit("value").alias("action"), "value", F.lit(None).cast("map<string,string>").alias("fields"))
    recipe = RC.build_recipe(derive(spark, sf, "mappings"), derive(spark, sf, "trail"), given, PARTY, "run")
    return RC.replay_recipe(recipe, A.answers_frame(spark, {"enum:segment:w1": "mine"})).select("subject", "value")


@query(f"""WITH {ctes('pushed')} SELECT key, CASE WHEN push_status = 'failed' THEN 'pending' ELSE push_status END AS push_status FROM pushed""")
def run_store(spark, sf):
    """Write a run's records, rewrite them from their own contents, read one run back."""
    store = RunStore(spark, scratch(spark, "store"))
    store.replace("records", "a", derive(spark, sf, "pushed"))
    store.replace("records", "b", derive(spark, sf, "pushed").withColumn("push_status", F.lit("other")))
    store.update_records("a", lambda r: r.withColumn("push_status", F.when(F.col("push_status") == "failed", "pending").otherwise(F.col("push_status"))))
    return store.read("records", "a").select("key", "push_status")


# -- A25-A27 -----------------------------------------------------------------

@query(f"WITH {ctes('trail')} SELECT id, actor, action, entity FROM trail WHERE actor = 'agent' AND contains(lower(entity || ' ' || action || ' ' || rationale), 'k1')")
def audit_review(spark, sf):
    """By actor and free text."""
    return W.search_audit(derive(spark, sf, "trail"), "agent", "K1").select("id", "actor", "action", "entity")


@query(f"WITH {ctes('trail')} SELECT 'actor' AS what, actor AS name, count(*) AS n FROM trail GROUP BY 2 UNION ALL SELECT 'action', action, count(*) FROM trail WHERE actor = 'agent' GROUP BY 2")
def audit_counts(spark, sf):
    """Per actor, and what was done unasked."""
    trail = derive(spark, sf, "trail")
    return (W.actor_counts(trail).select(F.lit("actor").alias("what"), F.col("actor").alias("name"), "n")
            .unionByName(W.agent_actions(trail).select(F.lit("action").alias("what"), F.col("action").alias("name"), "n")))


@query(f"WITH {ctes('trail')} SELECT id, \"at\", action FROM trail ORDER BY \"at\", id LIMIT 1000")
def audit_listing(spark, sf):
    """The first page of the trail."""
    return W.audit_listing(derive(spark, sf, "trail")).select("id", "at", "action")


@query(f"WITH {ctes('mappings')}, f AS (SELECT unnest(['employee_code', 'work_email', 'full_name', 'segment', 'balance']) AS name) SELECT name FROM f WHERE name NOT IN (SELECT target_field FROM mappings WHERE target_field IS NOT NULL)")
def unreached_fields(spark, sf):
    """A26, S3."""
    return W.unreached_fields(derive(spark, sf, "mappings"), PARTY).select("name")


@query(f"""WITH q AS ({plain(_QUEUE)}), {ctes('mappings', 'pushed')} SELECT 'questions' AS what, type AS name, count(*) AS n FROM q GROUP BY 2
  UNION ALL SELECT 'mappings', 'small', count(*) FROM mappings WHERE disposition = 'auto' AND contains(lower("column" || ' ' || coalesce(target_field, '') || ' ' || reason), 'small')
  UNION ALL SELECT 'records', 'building', count(*) FROM pushed WHERE push_status = 'success' AND contains(lower(key || ' ' || employee_code || ' ' || full_name || ' ' || segment), 'building')
  UNION ALL SELECT 'plan', 'k1', count(*) FROM pushed WHERE {_BUCKET} = 'will_send' AND contains(lower(key || ' ' || employee_code), 'k1')""")
def question_counts(spark, sf):
    """Open questions by type, and the searches over mappings, records and plan."""
    records = _party(derive(spark, sf, "pushed"))
    one = lambda df, what, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(what).alias("what"), F.lit(name).alias("name"), "n")      # noqa: E731
    counts = J.question_counts(sql(spark, sf, _QUEUE)).select(F.lit("questions").alias("what"), F.col("type").alias("name"), "n")
    return (counts.unionByName(one(W.search_mappings(derive(spark, sf, "mappings"), "auto", "small"), "mappings", "small"))
            .unionByName(one(W.search_records(records, PARTY, "success", "Building"), "records", "building"))
            .unionByName(one(W.search_plan(P.build_plan(records, PARTY), "will_send", "K1"), "plan", "k1")))


# -- questions, end to end, streaming ----------------------------------------

@query(f"""WITH {_OUTCOME} SELECT 'push:' || key AS subject, 'push_rejected' AS type FROM o WHERE status >= 400 AND NOT (SELECT count(CASE WHEN status >= 400 THEN 1 END) >= 5
    AND count(CASE WHEN status >= 400 THEN 1 END) / count(*) >= 0.5 FROM o)
  UNION ALL SELECT 'batch:push_rejected', 'batch_anomaly' WHERE (SELECT count(CASE WHEN status >= 400 THEN 1 END) >= 5 AND count(CASE WHEN status >= 400 THEN 1 END) / count(*) >= 0.5 FROM o)""")
def push_questions(spark, sf):
    """Q13, Q14: single refusals, or one question when they are one fact."""
    out = cut(L.load_into_table(sql(spark, sf, _BATCH), sql(spark, sf, _TARGET))[0])
    return Q.after_push(out, L.rejection_flood(out)).select("subject", "type")


@query()
def reconcile_exports(spark, sf):
    """Two exports of every customer, end to end."""
    people = derive(spark, sf, "people")
    hris = people.select("id", F.col("employee_code").alias("Emp ID"), F.col("first_name").alias("First Name"), F.col("last_name").alias("Surname"), F.col("work_email").alias("Office Email"),
                         F.col("date_of_birth").alias("DOB"), F.col("date_of_joining").alias("Joining Date"), F.col("department").alias("Department"), F.col("status").alias("Status"))
    pay = people.select("id", F.col("employee_code").alias("employee number"), F.col("date_of_joining").alias("hire date"), F.col("pan").alias("pan"), F.col("phone").alias("mobile"))
    result = run({"hris": from_table(hris, "hris", "id"), "payroll": from_table(pay, "payroll", "id")}, EMPLOYEE, "q")
    return result.summary()


@query(f"WITH {ctes('people')}, i AS ({_issues_sql('people')}) SELECT id, count(*) AS issues FROM i GROUP BY id")
def stream_checks(spark, sf):
    """The same checks on a stream of the given table: stateless, rules folded in."""
    stream = spark.readStream.schema(table(spark, sf, "customer").schema).parquet(f"{sf.rstrip('/')}/customer.parque[t]")
    stream.createOrReplaceTempView("customer_stream")
    people = spark.sql(DERIVED["people"].replace("{customer}", "customer_stream").replace('"', "`"))
    return drain(checked(people, PERSON).select("id", F.size("issues").alias("issues")).where("issues > 0"), "stream_checks")
