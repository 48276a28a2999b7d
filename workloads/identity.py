"""Queries over records: grouping, merging, near duplicates, references, matching."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from loomfold.functions.similarity import plain_ratio, score_pairs
from loomfold.lineage import cut
from loomfold.operators import answers as A, match as M, references as R, resolve as E
from workloads.inputs import ctes, derive, plain, sql, table
from workloads.specs import DOCUMENT, PARTY, TRADE
from workloads.values import lcs_sql, ratio_sql

QUERIES, ORACLE = {}, {}


def query(oracle: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if oracle is not None:
            ORACLE[fn.__name__] = oracle
        return fn
    return register


# -- J1, A7, A8 --------------------------------------------------------------

_IDS = """i AS (SELECT _source, _file, _ord, trim(lower(employee_code)) AS c, trim(lower(work_email)) AS m FROM exports),
  nodes AS (SELECT 'c' || c AS node, _source, _ord FROM i WHERE c <> '' UNION ALL SELECT 'm' || m, _source, _ord FROM i WHERE m <> ''),
  pairs AS (SELECT DISTINCT a._source AS s, b._source AS t, b._ord AS o FROM nodes a JOIN nodes b USING (node)),
  walk AS (SELECT _source AS s, _source AS t, _ord AS o FROM i UNION SELECT w.s, p.t, p.o FROM walk w JOIN pairs p ON w.t = p.s),
  comp AS (SELECT s AS _source, min(o) AS root FROM walk GROUP BY s)"""


@query(f"WITH RECURSIVE {ctes('exports')}, {_IDS} SELECT _source AS source, root, count(*) OVER (PARTITION BY root) AS n FROM comp")
def connected_records(spark, sf):
    """Rows of two exports grouped through shared codes and addresses."""
    records, members = E.resolve_records(derive(spark, sf, "exports"), PARTY)
    return members.join(records.select("_rid", "_seq", "n_sources"), "_rid").select(
        F.col("_source").alias("source"), F.col("_seq").alias("root"), F.col("n_sources").alias("n"))


_FIELDS = ("employee_code", "work_email", "full_name", "segment", "balance")
_FULL = " + ".join(f"CASE WHEN {f} <> '' THEN 1 ELSE 0 END" for f in _FIELDS)
_RANKED = f"r AS (SELECT e.*, c.root, row_number() OVER (PARTITION BY c.root ORDER BY {_FULL} DESC, e._ord) AS k FROM exports e JOIN comp c USING (_source))"
_BEST = ", ".join(f"coalesce(arg_min({f}, k) FILTER (WHERE {f} <> ''), '') AS {f}" for f in _FIELDS)


@query(f"""WITH RECURSIVE {ctes('exports')}, {_IDS}, {_RANKED}, g AS (SELECT root, {_BEST}, count(*) AS n_sources, arg_min(_source, k) AS first_source,
    CASE WHEN min(_file) = max(_file) THEN min(_file) END AS file,
    max(CASE WHEN employee_code <> '' THEN cc END) AS same_code, max(CASE WHEN work_email <> '' THEN mm END) AS same_mail
    FROM (SELECT *, count(*) OVER (PARTITION BY root, lower(employee_code)) AS cc, count(*) OVER (PARTITION BY root, lower(work_email)) AS mm FROM r) GROUP BY root)
  SELECT CASE WHEN employee_code <> '' THEN employee_code WHEN work_email <> '' THEN work_email ELSE first_source END AS key, {', '.join(_FIELDS)}, n_sources, first_source, file,
    CASE WHEN same_code > 1 THEN 'employee_code' WHEN same_mail > 1 THEN 'work_email' END AS basis FROM g""")
def merge_most_complete(spark, sf):
    """One aggregate with associative first-in-rank values."""
    records, _ = E.resolve_records(derive(spark, sf, "exports"), PARTY)
    return records.select("key", *_FIELDS, "n_sources", "first_source", "file", "basis")


_MELT = " UNION ALL ".join(f"SELECT root, k, '{f}' AS field, {f} AS value FROM r WHERE {f} <> ''" for f in _FIELDS)


@query(f"""WITH RECURSIVE {ctes('exports')}, {_IDS}, {_RANKED}, v AS ({_MELT}), kept AS (SELECT root, field, arg_min(value, k) AS kept FROM v GROUP BY ALL)
  SELECT v.root, v.field, kept.kept, v.value AS seen, count(*) AS n FROM v JOIN kept USING (root, field) WHERE trim(lower(v.value)) <> trim(lower(kept.kept)) GROUP BY ALL""")
def merge_conflicts(spark, sf):
    """Values that lost, told apart where each row meets its record."""
    records, members = E.resolve_records(derive(spark, sf, "exports"), PARTY, carry=_FIELDS)
    records = cut(records)
    return E.merge_conflicts(members, records, _FIELDS).join(records.select("_rid", F.col("_seq").alias("root")), "_rid").select("root", "field", "kept", "seen", "n")


_DOCS = """SELECT 'documents' AS _file, doc_id AS _ord, 'documents#' || CAST(doc_id AS STRING) AS _source, md5(text) AS raw_hash,
  md5(lower(replace(text, ' ', ''))) AS norm_hash, CASE WHEN doc_id % 3 = 0 THEN '' ELSE lang END AS lang,
  CASE WHEN doc_id % 2 = 0 THEN '' ELSE source END AS source, CAST(n_chars AS STRING) AS size FROM {documents}"""


@query(f"""WITH d AS ({plain(_DOCS)}), r AS (SELECT *, row_number() OVER (PARTITION BY norm_hash ORDER BY CASE WHEN lang <> '' THEN 1 ELSE 0 END + CASE WHEN source <> '' THEN 1 ELSE 0 END DESC, _ord) AS k FROM d)
  SELECT min(_ord) AS first_doc, count(*) AS n_sources, coalesce(arg_min(lang, k) FILTER (WHERE lang <> ''), '') AS lang, coalesce(arg_min(source, k) FILTER (WHERE source <> ''), '') AS source,
    arg_min(size, k) AS size FROM r GROUP BY norm_hash""")
def document_entities(spark, sf):
    """J1 + A7 over whole texts: copies are one entity."""
    records, _ = E.resolve_records(sql(spark, sf, _DOCS), DOCUMENT)
    return records.select(F.col("_seq").alias("first_doc"), "n_sources", "lang", "source", "size")


@query(f"""WITH RECURSIVE {ctes('exports')}, {_IDS}, {_RANKED}
  SELECT root, k AS position, _source AS source FROM r""")
def record_sources(spark, sf):
    """The source rows of each record, most complete first, as a long table."""
    records, members = E.resolve_records(derive(spark, sf, "exports"), PARTY)
    return E.source_rows(members).join(records.select("_rid", F.col("_seq").alias("root")), "_rid").select("root", "position", "source")


# -- J2, J3, A13 -------------------------------------------------------------

_LINES = """SELECT 'r' AS _rid, CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || '-' || CAST(l_suppkey AS STRING) AS key,
  CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || '-' || CAST(l_suppkey AS STRING) AS _seq,
  CAST(l_partkey AS STRING) AS pan, CAST(l_suppkey AS STRING) AS employee_code, substring(CAST(l_shipdate AS STRING), 1, 10) AS date_of_joining FROM {lineitem}"""


@query(f"""WITH l AS ({plain(_LINES)}) SELECT pan AS person, count(*) AS n_records, count(DISTINCT employee_code) AS n_codes, arg_min(key, (date_of_joining, _seq)) AS earlier_key,
  arg_max(key, (date_of_joining, _seq)) AS later_key, 'rehire:' || least(arg_min(key, (date_of_joining, _seq)), arg_max(key, (date_of_joining, _seq))) || '|' ||
  greatest(arg_min(key, (date_of_joining, _seq)), arg_max(key, (date_of_joining, _seq))) AS subject FROM l GROUP BY pan HAVING count(*) >= 2 AND count(DISTINCT employee_code) >= 2""")
def shared_id_conflict(spark, sf):
    """One person identifier under several codes."""
    return E.shared_person_id(sql(spark, sf, _LINES), "pan", "employee_code", "date_of_joining")


_NAMED = f"""{ctes('named')}, n AS (SELECT _rid, key, _seq, file, trim(lower(date_of_birth)) AS dob, trim(lower(first_name)) AS "first", trim(lower(last_name)) AS "last", trim(lower(pan)) AS pan
    FROM named WHERE date_of_birth <> '' AND trim(last_name) <> ''),
  g AS (SELECT dob, "first", "last", count(*) AS n FROM n GROUP BY ALL),
  texts AS (SELECT DISTINCT a."last" AS x, b."last" AS y FROM g a JOIN g b ON a.dob = b.dob AND a."first" = b."first" AND a."last" < b."last"),
  sims AS (SELECT x, y, CASE WHEN greatest(len(x), len(y)) / least(len(x), len(y)) < 1.5 THEN {ratio_sql('x', 'y')} ELSE 0 END AS s,
    least(len(x), len(y)) <= 3 AND (starts_with(x, y) OR starts_with(y, x)) AS abbr FROM texts),
  l AS (SELECT a.dob, a."first", a."last" AS value_a, b."last" AS value_b, CASE WHEN s >= 92 THEN s END AS similarity FROM g a JOIN g b ON a.dob = b.dob AND a."first" = b."first" AND a."last" < b."last"
      JOIN sims ON sims.x = a."last" AND sims.y = b."last" WHERE s >= 92 OR abbr
    UNION ALL SELECT dob, "first", "last", "last", 100.0 FROM g WHERE n > 1),
  pairs AS (SELECT l.dob, l."first", l.value_a, l.value_b, l.similarity, a._rid AS rid_a, b._rid AS rid_b, a.file AS fa, b.file AS fb, a._seq + b._seq AS seqs FROM l
    JOIN n a ON a.dob = l.dob AND a."first" = l."first" AND a."last" = l.value_a JOIN n b ON b.dob = l.dob AND b."first" = l."first" AND b."last" = l.value_b
    WHERE (l.value_a <> l.value_b OR a._seq < b._seq) AND (a.pan = '' OR a.pan <> b.pan))"""


def _named(spark, sf):
    records = derive(spark, sf, "named")
    named = cut(E.name_groups(records, "date_of_birth", "first_name", "last_name", "pan"))
    return records, named, cut(E.near_name_links(named))


@query(f"WITH {_NAMED} SELECT dob, \"first\", value_a, value_b, round(similarity, 4) AS similarity, count(*) AS n_pairs FROM pairs GROUP BY ALL")
def near_duplicates(spark, sf):
    """Links between distinct names and the record pairs they stand for."""
    _, named, links = _named(spark, sf)
    return E.count_pairs(named, links).select("dob", "first", "value_a", "value_b", F.round("similarity", 4).alias("similarity"), "n_pairs")


@query(f"WITH {_NAMED}, e AS (SELECT rid_a AS r FROM pairs UNION ALL SELECT rid_b FROM pairs) SELECT r AS record, count(*) AS n_partners FROM e GROUP BY r")
def near_duplicate_records(spark, sf):
    """J3 per record, without listing a pair."""
    _, named, links = _named(spark, sf)
    return E.near_duplicate_records(named, links).select(F.col("_rid").alias("record"), "n_partners")


@query(f"""WITH {_NAMED}, top AS (SELECT least(fa, fb) AS x, greatest(fa, fb) AS y FROM pairs WHERE fa <> fb AND seqs % 3 <> 0 GROUP BY 1, 2 ORDER BY count(*) DESC, 1, 2 LIMIT 1),
  o AS (SELECT 'open' AS scope, rid_a, rid_b FROM pairs WHERE seqs % 3 <> 0
    UNION ALL SELECT 'apart', rid_a, rid_b FROM pairs, top WHERE seqs % 3 <> 0 AND NOT coalesce(fa <> fb AND fa IN (x, y) AND fb IN (x, y), false)),
  e AS (SELECT scope, rid_a AS r FROM o UNION ALL SELECT scope, rid_b FROM o) SELECT scope, r AS record, count(*) AS n_partners FROM e GROUP BY scope, r""")
def open_partners(spark, sf):
    """What is left per record once a third of the pairs is answered, and once two files are one question besides."""
    _, named, links = _named(spark, sf)
    thirds = named.withColumn("third", F.pmod("_seq", F.lit(3)))
    asked = lambda x, y: (x["third"] + y["third"]) % 3 != 0
    top = E.pairs_by_files(thirds, links, by=["third"], is_open=asked).orderBy(F.desc("n_pairs"), "file_a", "file_b").limit(1).collect()
    one = lambda scope, rows, by, is_open: E.partners_by_class(rows, links, by, is_open).select(F.lit(scope).alias("scope"), F.col("_rid").alias("record"), "n_partners")
    everywhere = one("open", thirds, ["third"], asked)
    if not top:
        return everywhere
    x, y = top[0]["file_a"], top[0]["file_b"]
    sided = thirds.withColumn("side", F.when(F.col("file") == x, 1).when(F.col("file") == y, 2).otherwise(0))
    return everywhere.unionByName(one("apart", sided, ["third", "side"], lambda a, b: asked(a, b) & (a["side"] * b["side"] != 2)))


@query(f"WITH {_NAMED} SELECT least(fa, fb) AS file_a, greatest(fa, fb) AS file_b, count(*) AS n_pairs FROM pairs WHERE fa <> fb GROUP BY 1, 2")
def pairs_by_files(spark, sf):
    """A13's counts."""
    _, named, links = _named(spark, sf)
    return E.pairs_by_files(named, links)


@query(f"""WITH {_NAMED}, p AS (SELECT least(fa, fb) AS file_a, greatest(fa, fb) AS file_b, count(*) AS n_pairs FROM pairs WHERE fa <> fb GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 1),
  s AS (SELECT file, count(*) AS rows FROM named GROUP BY file)
  SELECT p.*, a.rows AS rows_a, b.rows AS rows_b, n_pairs >= 10 AND n_pairs / least(a.rows, b.rows) >= 0.5 AS flood, 'identity-batch:' || file_a || '|' || file_b AS subject
  FROM p JOIN s a ON a.file = file_a JOIN s b ON b.file = file_b""")
def cross_file_flood(spark, sf):
    """Many pairs between two files are one question."""
    records, named, links = _named(spark, sf)
    return E.cross_file_flood(named, links, records)


@query(f"""WITH x AS (SELECT DISTINCT lower(p_type) AS a, lower(p_name) AS b FROM part) SELECT p.p_partkey, round({ratio_sql('a', 'b')}, 6) AS plain
  FROM part p JOIN x ON x.a = lower(p.p_type) AND x.b = lower(p.p_name)""")
def score_distinct_pairs(spark, sf):
    """a score per distinct pair of texts, joined back."""
    pairs = table(spark, sf, "part").select("p_partkey", F.lower("p_type").alias("a"), F.lower("p_name").alias("b"))
    distinct = pairs.select("a", "b").distinct().withColumn("plain", F.round(plain_ratio(F.col("a"), F.col("b")), 6))
    return pairs.join(distinct, ["a", "b"]).select("p_partkey", "plain")


_SORTED = "array_to_string(list_sort(list_filter(string_split({x}, ' '), lambda w: w <> '')), ' ')"
_ONCE = "list_sort(list_distinct(list_filter(string_split({x}, ' '), lambda w: w <> '')))"
def weighted_ctes(pairs: str) -> str:
    """SQL: ``scored`` (a, b, score, words) for the distinct non-empty pairs (a, b) that ``pairs`` selects: weighted blend and word-sorted ratio."""
    return f"""x AS ({pairs}),
  q AS (SELECT a, b, {_ONCE.format(x='a')} AS wa, {_ONCE.format(x='b')} AS wb, greatest(len(a), len(b)) / least(len(a), len(b)) AS spread FROM x),
  f AS (SELECT a, b, spread, 'plain' AS form, a AS x, b AS y FROM q UNION ALL SELECT a, b, spread, 'sorted', {_SORTED.format(x='a')}, {_SORTED.format(x='b')} FROM q
    UNION ALL SELECT a, b, spread, 'once', array_to_string(wa, ' '), array_to_string(wb, ' ') FROM q),
  o AS (SELECT a, b, form, CASE WHEN len(x) <= len(y) THEN x ELSE y END AS s, CASE WHEN len(x) <= len(y) THEN y ELSE x END AS l FROM f WHERE spread >= 1.5),
  w AS (SELECT a, b, form, s, substring(l, greatest(0, i) + 1, least(len(l), i + len(s)) - greatest(0, i)) AS win FROM o, unnest(range(1 - len(s), len(l))) AS r(i)),
  d AS (SELECT s, win, {ratio_sql('s', 'win')} AS score FROM (SELECT DISTINCT s, win FROM w)),
  p AS (SELECT a, b, max(CASE WHEN form = 'plain' THEN score END) AS part, max(CASE WHEN form <> 'plain' THEN score END) AS part_words FROM w JOIN d USING (s, win) GROUP BY a, b),
  t AS (SELECT a, b, spread, len(list_intersect(wa, wb)) AS common, len(array_to_string(list_intersect(wa, wb), ' ')) AS sh, array_to_string(list_filter(wa, lambda v: NOT list_contains(wb, v)), ' ') AS ra,
    array_to_string(list_filter(wb, lambda v: NOT list_contains(wa, v)), ' ') AS rb, {ratio_sql('a', 'b')} AS plain FROM q),
  u AS (SELECT *, CASE WHEN common > 0 THEN 1 ELSE 0 END AS gap, sh + CASE WHEN common > 0 THEN 1 ELSE 0 END + len(ra) AS la, sh + CASE WHEN common > 0 THEN 1 ELSE 0 END + len(rb) AS lb, {lcs_sql('ra', 'rb')} AS c FROM t),
  z AS (SELECT u.*, CASE WHEN common > 0 AND (ra = '' OR rb = '') THEN 100.0 ELSE greatest(100 - 100.0 * (len(ra) + len(rb) - 2 * c) / (la + lb),
      CASE WHEN common > 0 THEN 100 - 100.0 * (1 + len(ra)) / (sh + la) ELSE 0 END, CASE WHEN common > 0 THEN 100 - 100.0 * (1 + len(rb)) / (sh + lb) ELSE 0 END) END AS sets,
    g.words FROM u JOIN (SELECT a, b, {ratio_sql('x', 'y')} AS words FROM f WHERE form = 'sorted') g USING (a, b)),
  scored AS (SELECT z.a, z.b, CASE WHEN spread < 1.5 THEN greatest(plain, 0.95 * greatest(words, sets))
    ELSE greatest(plain, CASE WHEN spread <= 8 THEN 0.9 ELSE 0.6 END * part, 0.95 * CASE WHEN spread <= 8 THEN 0.9 ELSE 0.6 END * CASE WHEN common > 0 THEN 100 ELSE part_words END) END AS score, words
    FROM z LEFT JOIN p USING (a, b))"""


_WEIGHTED = weighted_ctes("""SELECT DISTINCT lower(p_type) AS a, lower(p_name) AS b FROM part UNION SELECT DISTINCT lower(p_name), lower(p_type || ' ' || p_name) FROM part
    UNION SELECT DISTINCT lower(p_name), lower(substring(p_brand, 7) || ' ' || p_name) FROM part""")


@query(f"""WITH {_WEIGHTED} SELECT p_partkey, round(v.score, 4) AS by_type, round(w.score, 4) AS by_label, round(y.score, 4) AS by_number FROM part
  JOIN scored v ON v.a = lower(p_type) AND v.b = lower(p_name) JOIN scored w ON w.a = lower(p_name) AND w.b = lower(p_type || ' ' || p_name)
  JOIN scored y ON y.a = lower(p_name) AND y.b = lower(substring(p_brand, 7) || ' ' || p_name)""")
def weighted_scores(spark, sf):
    """the weighted blend of every part's name with its type, with both together and with a number before it."""
    parts = table(spark, sf, "part").select("p_partkey", F.lower("p_type").alias("a"), F.lower("p_name").alias("b"), F.lower(F.concat_ws(" ", "p_type", "p_name")).alias("c"), F.lower(F.concat_ws(" ", F.substr("p_brand", F.lit(7)), "p_name")).alias("d"))
    by_type = score_pairs(parts, "a", "b", "by_type")
    scored = score_pairs(score_pairs(by_type, "b", "c", "by_label"), "b", "d", "by_number")
    return scored.select("p_partkey", *[F.round(c, 4).alias(c) for c in ("by_type", "by_label", "by_number")])


# -- J10, J16 ----------------------------------------------------------------

@query(f"""WITH {ctes('exports')}, h AS (SELECT *, min(_ord) OVER (PARTITION BY _ord - _ord % 1000000000000 % 12) AS root FROM exports),
  r AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY _ord) AS k FROM h)
  SELECT root, {_BEST}, count(*) AS n_sources FROM r GROUP BY root""")
def apply_merges(spark, sf):
    """Merge answers with chains and with loops of two, three and four records, resolved before anything is absorbed."""
    rows = derive(spark, sf, "exports")
    records = rows.select(*_FIELDS, F.concat(F.lit("r"), F.lpad(F.col("_ord").cast("string"), 16, "0")).alias("_rid"), F.col("_ord").alias("_seq"), F.col("_source").alias("first_source"),
                          F.lit(1).cast("long").alias("n_sources"), F.col("_source").alias("key"), F.col("_file").alias("file"), F.lit(None).cast("string").alias("basis"))
    rid = lambda c: F.concat(F.lit("r"), F.lpad(c.cast("string"), 16, "0"))           # noqa: E731
    o = F.col("_seq")
    # groups of twelve rows: by turns a chain, a star of chains, and loops of 2, 3 and 4 with tails
    group = o - o % 1000000000000 % 12
    placed = records.select(o.alias("o"), group.alias("group"), (group / 12 % 5).cast("int").alias("shape"),
                            (F.row_number().over(Window.partitionBy(group).orderBy(o)) - 1).alias("k"), F.count(F.lit(1)).over(Window.partitionBy(group)).alias("size"))
    k, loop = F.col("k"), F.least(F.col("size"), F.when(F.col("shape") >= 2, F.col("shape")).otherwise(1))
    star = F.when(k % 3 == 0, k - 3).otherwise(k - k % 3)
    there = F.when(F.col("shape") == 1, star).when(k < loop, (k + 1) % loop).otherwise(k - 1)
    sent = placed.where((k > 0) | (loop > 1)).select("group", F.col("o").alias("from"), there.alias("k"))
    merges = sent.join(placed.select("group", "k", F.col("o").alias("to")), ["group", "k"]).select(rid(F.col("from")).alias("member"), rid(F.col("to")).alias("winner"))
    members = rows.select(rid(F.col("_ord")).alias("_rid"), "_source")
    merged, _ = E.apply_merges(records, members, merges, PARTY)
    return merged.select(F.col("_seq").alias("root"), *_FIELDS, "n_sources")


@query("""SELECT 'push:K' || CAST(o_custkey AS VARCHAR) AS subject, CASE WHEN o_custkey % 10 = 0 THEN 'edit' ELSE 'skip' END AS value FROM (SELECT DISTINCT o_custkey FROM orders)
  UNION ALL SELECT 'push:K' || CAST(c_custkey AS VARCHAR), 'edit' FROM customer WHERE c_custkey % 10 = 0 AND c_custkey NOT IN (SELECT o_custkey FROM orders)
  UNION ALL SELECT 'batch:push_rejected', 'skip'""")
def expand_batch_answer(spark, sf):
    """One batch answer becomes an answer per record nobody answered yet."""
    refs = table(spark, sf, "orders").select(F.lit("batch:push_rejected").alias("subject"), F.concat(F.lit("K"), F.col("o_custkey").cast("string")).alias("ref"))
    given = table(spark, sf, "customer").where("c_custkey % 10 = 0").select(
        F.concat(F.lit("push:K"), F.col("c_custkey").cast("string")).alias("subject"), F.lit("value").alias("action"), F.lit("edit").alias("value"),
        F.lit(None).cast("map<string,string>").alias("fields")).unionByName(A.answers_frame(spark, {"batch:push_rejected": "skip"}))
    return A.expand_skip_all(given, refs, "batch:push_rejected", "push").select("subject", "value")


# -- J4, J5 ------------------------------------------------------------------

@query(f"""WITH {ctes('reports')} SELECT trim(lower(manager_email)) AS missing, count(*) AS n_reports FROM reports WHERE trim(manager_email) <> ''
  AND trim(lower(manager_email)) NOT IN (SELECT lower(work_email) FROM reports) GROUP BY 1""")
def orphan_references(spark, sf):
    """An anti join of distinct values."""
    return R.orphan_references(derive(spark, sf, "reports"), "work_email", "manager_email")


@query(f"""WITH RECURSIVE {ctes('reports')}, f AS (SELECT lower(work_email) AS node, trim(lower(manager_email)) AS nxt FROM reports),
  w AS (SELECT node AS start, nxt AS cur, 1 AS steps, node AS least FROM f WHERE nxt <> '' UNION ALL
    SELECT w.start, f.nxt, w.steps + 1, least(w.least, f.node) FROM w JOIN f ON f.node = w.cur WHERE w.steps < 12 AND w.cur <> w.start AND f.nxt <> '')
  SELECT start AS node, least AS cycle FROM w WHERE cur = start AND steps > 1""")
def reference_cycles(spark, sf):
    """Pointer doubling; a record pointing at itself is no cycle."""
    return R.reference_cycles(R.reference_graph(derive(spark, sf, "reports"), "work_email", "manager_email"))


@query(f"""WITH RECURSIVE {ctes('reports')}, f AS (SELECT lower(work_email) AS node, trim(lower(manager_email)) AS nxt FROM reports),
  w AS (SELECT node AS start, nxt AS cur, 1 AS steps, node AS least FROM f WHERE nxt <> '' UNION ALL
    SELECT w.start, f.nxt, w.steps + 1, least(w.least, f.node) FROM w JOIN f ON f.node = w.cur WHERE w.steps < 12 AND w.cur <> w.start AND f.nxt <> '')
  SELECT least AS cycle, row_number() OVER (PARTITION BY least ORDER BY r.key) AS position, r.key FROM w JOIN reports r ON lower(r.work_email) = start WHERE cur = start AND steps > 1""")
def cycle_members(spark, sf):
    """Q12: the options of each cycle as rows."""
    graph = cut(R.reference_graph(derive(spark, sf, "reports"), "work_email", "manager_email"))
    return R.cycle_members(R.reference_cycles(graph), graph)


# -- matching ----------------------------------------------------------------

_CENT = """u AS (SELECT label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings),
  m AS (SELECT label, i, avg(CAST(v AS DOUBLE)) AS v FROM u GROUP BY ALL), cent AS (SELECT label, list(v ORDER BY i) AS c FROM m GROUP BY label),
  cs AS (SELECT e.vec_id, cent.label AS field, greatest(0.0, least(1.0, list_dot_product(CAST(e.embedding AS DOUBLE[]), cent.c) /
    (sqrt(list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[]))) * sqrt(list_dot_product(cent.c, cent.c))))) AS cosine FROM embeddings e, cent),
  z AS (SELECT *, avg(cosine) OVER w AS mu, stddev_pop(cosine) OVER w AS sd, max(cosine) OVER w AS mx FROM cs WINDOW w AS (PARTITION BY vec_id)),
  rel AS (SELECT vec_id, field, cosine, CASE WHEN mx > 0 AND sd >= 1e-6 THEN greatest(0.0, least(1.0, (cosine - mu) / (2.5 * sd))) ELSE 0.0 END AS relative FROM z)"""


def _relative(spark, sf):
    vectors = table(spark, sf, "embeddings")
    means = vectors.select("label", F.posexplode("embedding").alias("i", "v")).groupBy("label", "i").agg(F.avg(F.col("v").cast("double")).alias("v"))
    fields = means.groupBy(F.col("label").alias("field")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("embedding"))
    columns = vectors.select(F.lit("v").alias("file"), F.col("vec_id").alias("column"), F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))
    return M.relative_semantic(M.column_cosines(columns, fields))


@query(f"WITH {_CENT} SELECT vec_id, field, round(cosine, 6) AS cosine, round(relative, 6) AS relative FROM rel")
def candidate_scores(spark, sf):
    """Similarities standardised within each column's own candidate set."""
    return _relative(spark, sf).select(F.col("column").alias("vec_id"), "field", F.round("cosine", 6).alias("cosine"), F.round("relative", 6).alias("relative"))


@query(f"""WITH {_CENT}, k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY relative DESC, field) AS r, lead(relative) OVER (PARTITION BY vec_id ORDER BY relative DESC, field) AS nxt FROM rel)
  SELECT vec_id, field, round(relative, 6) AS top, round(relative - coalesce(nxt, 0), 6) AS margin,
    CASE WHEN relative < 0.5 THEN 'ignored' WHEN round(relative, 9) >= 0.82 AND round(relative - coalesce(nxt, 0), 9) >= 0.12 THEN 'auto' ELSE 'escalated' END AS verdict FROM k WHERE r = 1""")
def ranked_candidates(spark, sf):
    """Best candidate, margin over the runner-up, verdict."""
    w = Window.partitionBy("column").orderBy(F.desc("relative"), "field")
    top = _relative(spark, sf).withColumns({"r": F.row_number().over(w), "nxt": F.coalesce(F.lead("relative").over(w), F.lit(0.0))}).where("r = 1")
    margin = F.col("relative") - F.col("nxt")
    verdict = M.mapping_verdict(F.col("relative"), F.col("relative") - F.round(margin, 9), F.lit(1.0), F.lit(False))
    return top.select(F.col("column").alias("vec_id"), "field", F.round("relative", 6).alias("top"), F.round(margin, 6).alias("margin"), verdict.alias("verdict"))


@query()
def assign_columns(spark, sf):
    """Whole tables profiled, their columns matched."""
    from workloads.catalog import catalog

    profiles, vf = catalog(spark, sf)
    out = M.match_columns(profiles, TRADE, values=vf)
    return out.select("file", "column", "target_field", "disposition", F.round("confidence", 4).alias("confidence"), F.round("margin", 4).alias("margin"), "provenance", "contest")


_TRUTH = {("customer", "c_custkey"): "party_key", ("customer", "c_name"): "party_name", ("customer", "c_mktsegment"): "market_segment", ("customer", "c_nationkey"): "nation_key",
          ("customer", "c_acctbal"): "account_balance", ("supplier", "s_suppkey"): "party_key", ("supplier", "s_name"): "party_name", ("orders", "o_orderdate"): "order_date",
          ("orders", "o_orderstatus"): "order_status", ("orders", "o_totalprice"): "total_price", ("orders", "o_orderpriority"): "IGNORE", ("part", "p_size"): "IGNORE"}


@query()
def threshold_sweep(spark, sf):
    """9 x 7 grid, one small group per cell and file."""
    from workloads.catalog import catalog

    profiles, vf = catalog(spark, sf)
    truth = spark.createDataFrame([(f, c, e) for (f, c), e in _TRUTH.items()], "file string, column string, expected string")
    return M.sweep_thresholds(profiles, cut(M.score_candidates(profiles, TRADE, values=vf)), truth, TRADE, [0.60, 0.65, 0.70, 0.75, 0.78, 0.82, 0.86, 0.90, 0.95],
                              [0.00, 0.04, 0.08, 0.12, 0.16, 0.20, 0.30])


_MAPS = """SELECT 'map:' || p_brand || ':' || upper(p_name) AS subject, min(CASE WHEN p_size % 2 = 0 THEN 'segment' ELSE 'full_name' END) AS value FROM {part}
  GROUP BY p_brand, p_name"""
_COLS = "SELECT DISTINCT p_brand AS file, replace(p_name, ' ', '_') AS \"column\" FROM {part}"


@query(f"""WITH a AS ({plain(_MAPS)}), c AS ({plain(_COLS)}), g AS (SELECT split_part(subject, ':', 2) AS file, substring(subject, strpos(substring(subject, 5), ':') + 5) AS col, value, subject FROM a),
  s AS (SELECT replace(lower(col), '_', ' ') AS k, arg_min(value, subject) AS shared FROM g GROUP BY 1)
  SELECT c.file, c."column", coalesce(g.value, s.shared) AS answer FROM c LEFT JOIN g ON g.file = c.file AND g.col = c."column" JOIN s ON s.k = replace(lower(c."column"), '_', ' ')""")
def shared_answers(spark, sf):
    """An answer about a header holds in every file that has it."""
    given = sql(spark, sf, _MAPS).select("subject", F.lit("value").alias("action"), "value", F.lit(None).cast("map<string,string>").alias("fields"))
    return A.share_map_answers(given, sql(spark, sf, _COLS))


@query(f"""WITH a AS ({plain(_MAPS)}), k AS (SELECT subject, replace(lower(substring(subject, strpos(substring(subject, 5), ':') + 5)), '_', ' ') AS column_key, value AS target FROM a),
  u AS (SELECT replace(lower(p_name), '_', ' ') AS column_key, count(*) AS n FROM part GROUP BY 1)
  SELECT k.subject, k.column_key, k.target, coalesce(u.n, 0) AS times_used FROM k LEFT JOIN u USING (column_key)""")
def remembered_mappings(spark, sf):
    """Answers kept for later runs, and how often they were used."""
    given = sql(spark, sf, _MAPS).select("subject", F.lit("value").alias("action"), "value", F.lit(None).cast("map<string,string>").alias("fields"))
    empty = spark.createDataFrame([], "subject string, column_key string, target string, times_used long")
    used = table(spark, sf, "part").select(F.lower("p_name").alias("column_key"))
    return A.update_memory(empty, given, used)
