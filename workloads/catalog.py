"""Queries over the matcher's scores and the question catalogue."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from loomfold.lineage import cut, keep, scratch
from loomfold.operators import judge as J, load as L, match as M, references as R, resolve as E, validate as V, vocabulary as VO
from loomfold.operators.dates import column_votes, decide_conventions
from loomfold.operators.profile import profile_columns, value_frequency
from loomfold.plans import questions as Q
from loomfold.sources.tables import from_table
from loomfold.streaming.apply import clean_as_decided, drain, first_per_identifier
from workloads import identity, review, values
from workloads.identity import weighted_ctes
from workloads.inputs import DERIVED, ctes, derive, sql, table
from workloads.specs import PARTY, PERSON, SEGMENT, TRADE
from workloads.values import melt_sql

QUERIES, ORACLE = {}, {}


def query(oracle: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if oracle is not None:
            ORACLE[fn.__name__] = oracle
        return fn
    return register


# -- matching ----------------------------------------------------------------

#: Every given table with a column that orders its rows, and all columns that are text or become text.
CATALOG = {
    "region": ("r_regionkey", ["r_regionkey", "r_name"]), "nation": ("n_nationkey", ["n_nationkey", "n_name", "n_regionkey"]),
    "customer": ("c_custkey", ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]), "supplier": ("s_suppkey", ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"]),
    "part": ("p_partkey", ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]),
    "orders": ("o_orderkey", ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]),
    "lineitem": ("l_orderkey", ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]),
    "events": ("event_id", ["event_id", "ts", "user_id", "event_type", "value", "props"]), "documents": ("doc_id", ["doc_id", "text", "lang", "source", "n_chars"]),
    "embeddings": ("vec_id", ["vec_id", "label"]), "pages": ("page_id", ["page_id", "url", "html"]), "benchmark": ("item_id", ["item_id", "text"]),
    "labels": ("doc_id", ["doc_id", "quality", "toxic"]), "conversations": ("conv_id", ["conv_id", "turn", "role", "text"]),
}


def catalog(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Profiles and value frequencies of all columns of all given tables."""
    sources = {t: from_table(table(spark, sf, t).select(*cols), t, key) for t, (key, cols) in CATALOG.items()}
    vf = keep(value_frequency(sources))
    return cut(profile_columns(sources, vf)), vf


# The names each field of the contract goes by, in the contract's order, and what its kind of value asks for.
_FIELDS = {
    "party_key": (["party key", "custkey", "suppkey", "c custkey", "s suppkey"], "CASE WHEN non_null > 0 AND cardinality / non_null < 0.5 THEN -0.45 ELSE 0.0 END"),
    "party_name": (["party name", "c name", "s name"], "0.0"),
    "market_segment": (["market segment", "mktsegment", "segment"], "CASE WHEN non_null > 0 AND kind IN ('number', 'id') THEN -0.45 WHEN kind = 'string' OR segments >= 0.5 THEN 0.08 ELSE -0.18 END"),
    "nation_key": (["nation key", "nationkey", "c nationkey", "s nationkey"], "0.0"),
    "account_balance": (["account balance", "acctbal", "c acctbal", "s acctbal"], "0.0"),
    "order_date": (["order date", "orderdate", "o orderdate"], "CASE WHEN kind = 'date' THEN 0.08 ELSE -0.18 END"),
    "order_status": (["order status", "orderstatus", "o orderstatus"], "CASE WHEN non_null > 0 AND kind IN ('number', 'id') THEN -0.45 WHEN kind = 'string' OR states >= 0.5 THEN 0.08 ELSE -0.18 END"),
    "total_price": (["total price", "totalprice", "o totalprice"], "0.0"),
    "contact_email": (["contact email", "email"], "CASE WHEN non_null > 0 AND mails < 0.1 THEN -0.45 WHEN kind IN ('email', 'string') THEN 0.08 ELSE -0.18 END"),
}
_TERMS = ", ".join(f"('{f}', {i}, '{t}')" for i, (f, (terms, _)) in enumerate(_FIELDS.items()) for t in terms)
_ADJUST = "CASE field " + " ".join(f"WHEN '{f}' THEN {rule}" for f, (_, rule) in _FIELDS.items()) + " END"
_CELLS = " UNION ALL ".join(melt_sql(t, t, cols, key) for t, (key, cols) in CATALOG.items())
_PROFILES = values._PROFILE_SQL.split("\nf AS (SELECT")[0].rstrip().rstrip(",")


@query(f"""WITH cells AS ({_CELLS}) {_PROFILES},
  more AS (SELECT file, "column", sum(CASE WHEN ok AND upper(value) IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY') THEN n ELSE 0 END) AS seg,
    sum(CASE WHEN ok AND upper(value) IN ('F', 'O', 'P') THEN n ELSE 0 END) AS sta, sum(CASE WHEN ok AND regexp_matches(upper(value), '^[^@\\s]+@[^@\\s]+\\.[A-Za-z]{{2,}}$') THEN n ELSE 0 END) AS mail FROM r GROUP BY ALL),
  kinds AS (SELECT s.file, s."column", non_null, cardinality, seg / nullif(non_null, 0) AS segments, sta / nullif(non_null, 0) AS states, mail / nullif(non_null, 0) AS mails,
    CASE WHEN non_null = 0 THEN 'string' WHEN email / non_null >= 0.7 THEN 'email' WHEN dates / non_null >= 0.7 THEN 'date' WHEN phone / non_null >= 0.7 AND long THEN 'phone'
      WHEN ids / non_null >= 0.7 THEN 'id' WHEN num / non_null >= 0.9 THEN 'number' ELSE 'string' END AS kind FROM s JOIN more USING (file, "column")),
  terms(field, pos, term) AS (VALUES {_TERMS}), heads AS (SELECT DISTINCT "column", trim(replace(lower("column"), '_', ' ')) AS h FROM kinds),
  {weighted_ctes('SELECT DISTINCT h AS a, term AS b FROM heads, terms')},
  lex AS (SELECT "column", field, pos, max((0.5 * score + 0.5 * words) / 100) AS lexical FROM heads, terms JOIN scored ON a = h AND b = term GROUP BY ALL),
  g AS (SELECT file, "column", field, pos, lexical, greatest(0.0, least(1.0, lexical + {_ADJUST})) AS score FROM kinds JOIN lex USING ("column"))
  SELECT file, "column", field, round(score, 4) AS score, round(lexical, 4) AS lexical, row_number() OVER (PARTITION BY file, "column" ORDER BY round(score, 9) DESC, pos) AS rank FROM g""")
def match_scores(spark, sf):
    """Every column of every given table scored against every field."""
    profiles, vf = catalog(spark, sf)
    out = M.score_candidates(profiles, TRADE, values=vf)
    return out.select("file", "column", "field", F.round("score", 4).alias("score"), F.round("fuzzy_score", 4).alias("lexical"), "rank")


# -- questions ---------------------------------------------------------------

def _asked(*parts: DataFrame) -> DataFrame:
    shape = [p.select("type", "subject", F.array_join("options", ";").alias("options"), "n_affected") for p in parts]
    return reduce(DataFrame.unionByName, shape)


@query(f"""SELECT 'date_convention' AS type, 'date:orders:' || "column" AS subject, 'DMY;MDY' AS options, ambiguous AS n_affected FROM ({values.ORACLE['date_convention']}) WHERE outcome = 'ask'
  UNION ALL SELECT 'column_mapping', 'map:seg:' || field, '__ignore__;' || field, 0 FROM ({values.ORACLE['vocabulary_fit']}) WHERE contradicted""")
def questions_columns(spark, sf):
    """Q3, Q4: columns whose values argue against their field, and dates that can be read two ways."""
    vf = value_frequency({"orders": from_table(derive(spark, sf, "date_columns"), "orders", "_pos")})
    dates = decide_conventions(column_votes(vf), answers={"date:orders:unclear": "MDY"})
    fields = dates.withColumn("field", F.lit("order_date"))
    return _asked(Q.date_questions(fields), Q.vocabulary_questions(VO.vocabulary_fit(values._values(spark, sf))))


@query(f"""WITH unk AS ({values.ORACLE['unknown_vocabulary']}), opt AS (SELECT unnest(['Automobile', 'Building', 'Furniture', 'Household', 'Machinery']) AS option, unnest(range(5)) AS pos),
  {weighted_ctes('SELECT DISTINCT unk.value AS a, lower(option) AS b FROM unk, opt')},
  ranked AS (SELECT unk.field, unk.value, unk.affected_rows, option, row_number() OVER (PARTITION BY unk.field, unk.value ORDER BY round(score, 9) DESC, pos) AS k FROM unk CROSS JOIN opt JOIN scored ON a = unk.value AND b = lower(option))
  SELECT 'enum_value' AS type, 'enum:' || field || ':' || value AS subject, string_agg(option, ';' ORDER BY k) || ';__blank__' AS options, affected_rows AS n_affected FROM ranked WHERE k <= 4 GROUP BY field, value, affected_rows""")
def questions_words(spark, sf):
    """Unknown words with their closest options."""
    fit = values._values(spark, sf)
    return _asked(Q.enum_questions(VO.unknown_values(fit, VO.vocabulary_fit(fit))))


@query(f"""SELECT 'rehire_suspected' AS type, subject, 'separate;merge:' || later_key || ';merge:' || earlier_key AS options, n_records AS n_affected FROM ({identity.ORACLE['shared_id_conflict']})""")
def questions_people(spark, sf):
    """Q6: one person identifier under several codes."""
    return _asked(Q.rehire_questions(identity.QUERIES["shared_id_conflict"](spark, sf)))


@query(f"""WITH {identity._NAMED}, k AS (SELECT a.key AS ka, b.key AS kb, a._seq <= b._seq AS first FROM pairs JOIN n a ON a._rid = rid_a JOIN n b ON b._rid = rid_b)
  SELECT 'duplicate_suspected' AS type, 'identity:' || least(ka, kb) || '|' || greatest(ka, kb) AS subject,
    'separate;merge:' || CASE WHEN first THEN ka ELSE kb END || ';merge:' || CASE WHEN first THEN kb ELSE ka END AS options, 2 AS n_affected FROM k
  UNION ALL SELECT 'batch_anomaly', subject, 'merge_all;separate_all;review', n_pairs FROM ({identity.ORACLE['cross_file_flood']}) WHERE flood""")
def questions_pairs(spark, sf):
    """Q7, Q8: pairs that may be one person, and two files that look like one."""
    records, named, links = identity._named(spark, sf)
    return _asked(Q.duplicate_questions(E.list_pairs(named, links)), Q.flood_questions(E.cross_file_flood(named, links, records)))


_ASKED = ["employee_code", "last_name"]


@query(f"""SELECT 'validation_failed' AS type, 'record:' || CAST(id AS VARCHAR) AS subject, 'edit;skip' AS options, 1 AS n_affected FROM ({review.ORACLE['repair_rows']}) WHERE issues_left > 0
  UNION ALL SELECT 'field_unsourced', 'field:' || field, 'not_required;skip_records;remap', missing FROM ({review.ORACLE['missing_required']}) WHERE field IN ('employee_code', 'last_name')""")
def questions_records(spark, sf):
    """Q9, Q10: records that still fail after the repair, and fields that nothing feeds."""
    people = derive(spark, sf, "people").withColumns({"key": F.col("id").cast("string"), "push_status": F.lit("pending")})
    return _asked(Q.record_questions(V.validate_and_repair(people, PERSON), PERSON), Q.field_questions(V.missing_required(people, PERSON, pending={"department"}), _ASKED))


@query(f"""SELECT 'hierarchy_orphan' AS type, 'manager:' || missing AS subject, 'clear;edit' AS options, n_reports AS n_affected FROM ({identity.ORACLE['orphan_references']})
  UNION ALL SELECT 'hierarchy_cycle', 'cycle:' || string_agg(key, '|' ORDER BY position), string_agg('cycle-clear:' || key, ';' ORDER BY position), count(*) FROM ({identity.ORACLE['cycle_members']}) GROUP BY cycle""")
def questions_references(spark, sf):
    """Q11, Q12: references to nobody, and loops of references."""
    reports = derive(spark, sf, "reports")
    graph = cut(R.reference_graph(reports, "work_email", "manager_email"))
    return _asked(Q.orphan_questions(R.orphan_references(reports, "work_email", "manager_email")), Q.cycle_questions(R.cycle_subjects(R.reference_cycles(graph), graph)))


@query(f"""SELECT 'batch_anomaly' AS type, 'batch:coverage' AS subject, 'abort;continue' AS options, 0 AS n_affected FROM ({review.ORACLE['coverage']}) WHERE stop
  UNION ALL SELECT 'batch_anomaly', 'batch:rate', 'abort;continue', 0 FROM ({review.ORACLE['breaker']}) WHERE tripped IS NOT NULL""")
def questions_batch(spark, sf):
    """Q15, Q16: files about something else, and batches that need too many people."""
    total = table(spark, sf, "customer").agg(F.count(F.lit(1)).alias("n"))
    rate = J.batch_rate(sql(spark, sf, review._QUEUE), sql(spark, sf, review._REFS), total)
    return _asked(Q.coverage_question(J.mapping_coverage(derive(spark, sf, "mappings"), PARTY)), Q.rate_question(rate))


# -- audit of a load, texts for embeddings, batch answers --------------------

_NAME_FIELDS = ("date_of_birth", "first_name", "last_name", "pan")

@query(f"""WITH {review._OUTCOME} SELECT 'push_record' AS action, key, 'pending' AS before, 'auto' AS disposition, 'accepted ' || code AS rationale FROM o WHERE status < 400""")
def push_audit(spark, sf):
    """What a load leaves in the trail; refusals are questions, not entries."""
    outcomes = L.load_into_table(sql(spark, sf, review._BATCH), sql(spark, sf, review._TARGET))[0]
    return L.push_audit(outcomes).select("action", "key", "before", "disposition", "rationale")


@query(f"""SELECT file, "column", replace("column", '_', ' ') || '. Example values: ' || replace(samples, '|', ', ') AS text FROM ({values.ORACLE['profile_columns']})""")
def embed_texts(spark, sf):
    """what a column's vector is made from: its name and masked values."""
    return M.embed_texts(profile_columns({"customer": from_table(table(spark, sf, "customer"), "customer", "c_custkey"),
                                          "orders": from_table(table(spark, sf, "orders"), "orders", "o_orderkey")}))



@query(f"""WITH {identity._NAMED}, top AS (SELECT least(fa, fb) AS x, greatest(fa, fb) AS y FROM pairs WHERE fa <> fb GROUP BY 1, 2 ORDER BY count(*) DESC, 1, 2 LIMIT 1),
  side AS (SELECT n.*, CASE WHEN n.file = x THEN y ELSE x END AS across, ({' + '.join(f"CASE WHEN m.{f} <> '' THEN 1 ELSE 0 END" for f in _NAME_FIELDS)}) AS full_ FROM n JOIN named m USING (_rid), top WHERE n.file IN (x, y)),
  d AS (SELECT dob, "first", value_a AS "last", value_b AS other FROM l UNION SELECT dob, "first", value_b, value_a FROM l),
  met AS (SELECT a._rid AS rid, b._rid AS partner, a.full_ AS fa, a._seq AS sa, b.full_ AS fb, b._seq AS sb,
      row_number() OVER (PARTITION BY a._rid, d.other ORDER BY b.full_ DESC, b._seq) AS k
    FROM side a JOIN d ON d.dob = a.dob AND d."first" = a."first" AND d."last" = a."last" JOIN side b ON b.dob = d.dob AND b."first" = d."first" AND b."last" = d.other AND b.file = a.across
    WHERE a.pan = '' OR a.pan <> b.pan)
  SELECT DISTINCT CASE WHEN fb > fa OR (fb = fa AND sb < sa) THEN rid ELSE partner END AS member, CASE WHEN fb > fa OR (fb = fa AND sb < sa) THEN partner ELSE rid END AS winner FROM met WHERE k = 1""")
def merge_all_edges(spark, sf):
    """J16: "merge every pair" of the two files with most pairs: one edge to the fullest partner of each linked name."""
    records, named, links = identity._named(spark, sf)
    top = E.pairs_by_files(named, links).orderBy(F.desc("n_pairs"), "file_a", "file_b").limit(1).collect()
    return E.merge_all_edges(named, links, top[0]["file_a"], top[0]["file_b"], _NAME_FIELDS)


# -- streams -----------------------------------------------------------------

def _stream(spark, sf, name: str, derived: str | None = None) -> DataFrame:
    stream = spark.readStream.schema(table(spark, sf, name).schema).option("maxFilesPerTrigger", 1).parquet(f"{sf.rstrip('/')}/{name}.parque[t]")
    if derived is None:
        return stream
    stream.createOrReplaceTempView(f"{name}_stream")
    return spark.sql(DERIVED[derived].replace("{" + name + "}", f"{name}_stream").replace('"', "`"))


@query(f"SELECT pos, segment, asked FROM ({values._CLEAN_SEG})")
def stream_clean(spark, sf):
    """STR1: a stream cleaned by the newest decided words, which every micro-batch reads again."""
    folder = scratch(spark, "stream")
    decided = values._values(spark, sf).where("canonical IS NOT NULL").select("field", "value", "canonical")
    older = decided.withColumn("canonical", F.lit("Building")).withColumn("version", F.lit(1))
    older.unionByName(decided.withColumn("version", F.lit(2))).write.parquet(f"{folder}/words")
    maps = [{"column": "segment", "target_field": "segment"}]
    source = _stream(spark, sf, "customer", "segments").select("_pos", "segment")
    clean_as_decided(source, maps, SEGMENT, f"{folder}/words", f"{folder}/out", f"{folder}/state", keep=["_pos"]).awaitTermination()
    out = spark.read.parquet(f"{folder}/out")
    return out.select(F.col("_pos").alias("pos"), "segment", F.array_contains("_waiting", "segment").alias("asked"))


@query("SELECT user_id, count(DISTINCT event_type) AS kinds FROM events GROUP BY user_id")
def stream_first_seen(spark, sf):
    """STR2: one row for each user and kind of event, whatever repeats arrive within the delay."""
    events = _stream(spark, sf, "events").select(F.col("user_id").cast("string").alias("user_id"), "event_type", F.col("ts").cast("timestamp").alias("ts"))
    once = drain(first_per_identifier(events, ["user_id", "event_type"], "ts", "36500 days"), "first_seen")
    return once.groupBy(F.col("user_id").cast("long").alias("user_id")).agg(F.count(F.lit(1)).alias("kinds"))
