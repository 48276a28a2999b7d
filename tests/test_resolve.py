import random

import pytest
from pyspark.sql import functions as F

from loomfold.lineage import cut, salted_lookup
from loomfold.operators import resolve as E
from loomfold.operators.answers import answers_frame
from loomfold.operators.components import connected_components
from loomfold.operators.references import cycle_members, cycle_subjects, orphan_references, orphan_refs, reference_cycles, reference_graph
from loomfold.specs.employee import EMPLOYEE

COLS = ("_source", "_file", "_ord", "employee_code", "work_email", "pan", "first_name", "last_name", "date_of_birth", "date_of_joining", "grade")


def rows(spark, items, parts=3):
    full = [tuple(item.get(c, 0 if c == "_ord" else "") for c in COLS) for item in
            ({"_file": it["_source"].split("#")[0], "_ord": i, **it} for i, it in enumerate(items))]
    return spark.createDataFrame(full, ", ".join(f"{c} {'long' if c == '_ord' else 'string'}" for c in COLS)).repartition(parts)


def resolved(spark, items, parts=3):
    records, members = E.resolve_records(rows(spark, items, parts), EMPLOYEE)
    records = E.inline_sources(cut(records), members)
    return {r["key"]: r for r in records.collect()}, records, members


@pytest.mark.parametrize("parts", [1, 7])
def test_the_join_is_transitive_and_merging_prefers_the_fullest_row(spark, parts):
    got, _, _ = resolved(spark, [
        {"_source": "a.csv#2", "work_email": "A@x.com ", "first_name": "Mia", "grade": "L1"},
        {"_source": "b.csv#2", "employee_code": "E1", "last_name": "Brown"},
        {"_source": "c.csv#2", "work_email": "a@x.com", "employee_code": "e1", "pan": "P", "grade": "L2"},
        {"_source": "c.csv#3", "first_name": "Zed"}, {"_source": "c.csv#4", "first_name": "Zed"}], parts)
    one = got["e1"]
    assert one["sources"] == ["c.csv#2", "a.csv#2", "b.csv#2"] and (one["first_name"], one["last_name"], one["grade"]) == ("Mia", "Brown", "L2")
    assert one["basis"] == "employee_code" and one["n_sources"] == 3 and one["file"] is None
    assert len(got) == 3 and got["c.csv#3"]["n_sources"] == 1                       # no identifier: stands alone


def test_a_person_identifier_never_joins_rows_but_raises_a_question(spark):
    got, records, _ = resolved(spark, [
        {"_source": "a.csv#2", "employee_code": "E1", "pan": "ABCDE1234F", "date_of_joining": "2016-04-01"},
        {"_source": "a.csv#9", "employee_code": "E2", "pan": "abcde1234f ", "date_of_joining": "2022-07-01"},
        {"_source": "a.csv#10", "employee_code": "E3", "pan": "ZZ"}])
    assert len(got) == 3
    found = E.shared_person_id(records, "pan", "employee_code", "date_of_joining")
    row = found.collect()
    assert [(r["subject"], r["earlier_key"], r["later_key"], r["n_records"]) for r in row] == [("rehire:E1|E2", "E1", "E2", 2)]
    assert {r["ref"] for r in E.shared_person_refs(found, records, "pan").collect()} == {"E1", "E2"}


def test_conflicts_are_kept_apart_from_cosmetic_differences(spark):
    items = [{"_source": f"a.csv#{i}", "employee_code": "E1", "grade": g, "first_name": n} for i, (g, n) in enumerate([("L1", "Mia"), ("l1 ", "Mia"), ("L2", ""), ("L2", "")])]
    df = rows(spark, items)
    records, members = E.resolve_records(df, EMPLOYEE)
    placed = df.join(members.select("_source", "_rid", "_rank"), "_source")
    assert [(r["field"], r["kept"], r["seen"], r["n"]) for r in E.merge_conflicts(placed, cut(records), ["grade", "first_name"]).collect()] == [("grade", "L1", "L2", 2)]


def test_conflicts_send_no_value_that_won(spark):
    """One join of rows with their record, and only lost values are shuffled to be counted."""
    names = ["employee_code", "first_name", "last_name"]
    records = spark.createDataFrame([("r1", 3, "E1", "Asha", ""), ("r2", 1, "E2", "Ravi", "")], "_rid string, n_sources long, employee_code string, first_name string, last_name string")
    data = [("r1", 1, "e1 ", "Asha", ""), ("r1", 2, "E1", "Usha", None), ("r1", 3, "", "Usha", ""), ("r2", 4, "E2", "Ravi", "")]
    found = E.merge_conflicts(spark.createDataFrame(data, "_rid string, _rank int, employee_code string, first_name string, last_name string"), records, names)
    assert [(r["_rid"], r["field"], r["kept"], r["seen"], r["n"], r["_rank"]) for r in found.collect()] == [("r1", "first_name", "Asha", "Usha", 2, 2)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "Expand" not in plan


def test_one_identifier_on_a_third_of_all_rows(spark):
    items = [{"_source": f"a.csv#{i}", "employee_code": "E0" if i % 3 == 0 else f"E{i}", "work_email": f"m{i}@x.com"} for i in range(900)]
    records, members = E.resolve_records(rows(spark, items, 8), EMPLOYEE)
    records = cut(records)
    assert records.count() == 601 and records.agg(F.max("n_sources")).collect()[0][0] == 300 and members.count() == 900
    from dataclasses import replace
    from loomfold.spec import DEFAULT_POLICY
    shown = E.inline_sources(records, members, replace(DEFAULT_POLICY, inline_sources=100))
    assert shown.where("sources IS NULL").count() == 1                               # too long to inline, whole in members


def test_long_source_lists_and_cycles_are_whole(spark, monkeypatch):
    from pyspark.sql import functions as F
    from workloads import identity

    items = [{"_source": f"a.csv#{i:04d}", "employee_code": "E0"} for i in range(1_200)]
    monkeypatch.setattr(identity, "derive", lambda *_: rows(spark, items, 4))
    monkeypatch.setattr(identity, "PARTY", EMPLOYEE)
    got = identity.record_sources(spark, "").collect()
    assert [r["source"] for r in sorted(got, key=lambda r: r["position"])] == [x["_source"] for x in items] and {r["position"] for r in got} == set(range(1, 1_201))
    ring = spark.range(1_200).select(F.col("id").cast("string").alias("node"), F.format_string("k%04d", "id").alias("key"), F.col("id").alias("_rid"))
    (named,) = cycle_subjects(ring.select("node", F.lit("0").alias("cycle")), ring).collect()
    keys = [f"k{i:04d}" for i in range(1_200)]
    assert named["keys"] == keys and named["subject"] == "cycle:" + "|".join(keys) and named["n_members"] == 1_200
    listed = cycle_members(ring.select("node", F.lit("0").alias("cycle")), ring).collect()
    assert [(r["position"], r["key"]) for r in sorted(listed)] == [(i + 1, k) for i, k in enumerate(keys)]


def test_positions_in_a_group_of_a_third_of_all_rows(spark):
    """Hot, null, equal and single groups: places by order, and the hot group spans tasks."""
    from pyspark.sql import functions as F
    from loomfold.operators.positions import positions

    rows_ = [("hot", i * 7 % 1000, "x") for i in range(1000)] + [(None, i, "x") for i in range(50)] + [(f"g{i % 700}", i, "x") for i in range(1400)] + [("same", 1, "x")] * 500 + [("n", None, "x"), ("n", 0, "x")]
    df = spark.createDataFrame(rows_, "g string, o int, _at string").repartition(5)
    got = positions(df.withColumnRenamed("_at", "other"), ["g"], ["o"])
    assert got.columns == ["g", "o", "other", "position"]
    seen = {}
    for r in got.collect():
        seen.setdefault(r["g"], []).append((r["position"], r["o"]))
    for g, found in seen.items():
        found.sort()
        assert [p for p, _ in found] == list(range(1, len(found) + 1))
        assert [o for _, o in found] == sorted((o for k, o, _ in rows_ if k == g), key=lambda o: (o is not None, o or 0)), g
    assert positions(df.limit(0).drop("_at"), ["g"], ["o"]).count() == 0


def test_trees_are_peeled_before_pointers_are_doubled(spark):
    """One root over all rows, a star of chains and cycles with tails: the same cycles, and no task meets the trees."""
    from loomfold.operators.references import peeled, reference_cycles

    step = [(f"t{i}", f"t{(i - 1) // 5}") for i in range(1, 2000)] + [(f"s{c}-{i}", f"s{c}-{i - 1}" if i else "t0") for c in range(20) for i in range(40)]
    step += [("a", "b"), ("b", "c"), ("c", "a"), ("x", "y"), ("y", "x"), ("me", "me")] + [(f"tail{i}", "a" if i == 0 else f"tail{i - 1}") for i in range(30)]
    graph = spark.createDataFrame([(*s, s[0], s[0]) for s in step] + [("t0", "", "t0", "t0")], "node string, points_to string, key string, _rid string")
    assert {(r["node"], r["cycle"]) for r in reference_cycles(graph).collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("x", "x"), ("y", "x")}
    rest, n = peeled(graph.where("points_to <> '' AND points_to <> node").selectExpr("node", "points_to AS next"))
    assert n == rest.count() and rest.where("node LIKE 't%' AND node NOT LIKE 'tail%'").count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_union_find(spark, seed):
    rng = random.Random(seed)
    edges = [(f"n{rng.randrange(300)}", f"n{rng.randrange(300)}") for _ in range(180)] + [(f"c{i}", f"c{i + 1}") for i in range(120)] + [("hub", f"h{i}") for i in range(60)]
    parent: dict[str, str] = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    want = {x: find(x) for e in edges if e[0] != e[1] for x in e}
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == want


def test_stars_take_no_round_of_components(spark, monkeypatch):
    from loomfold.operators import components as G

    rounds = []
    monkeypatch.setattr(G, "_closer", lambda *a, f=G._closer, **k: rounds.append(1) or f(*a, **k))
    for edges, most in (([("a", f"h{i}") for i in range(40)] + [("b", "c")], 0), ([("a", "b"), ("b", "c"), ("c", "d")], 4)):
        got = {r["node"]: r["component"] for r in G.connected_components(spark.createDataFrame(edges, "a string, b string")).collect()}
        assert got == {x: "b" if most == 0 and x in "bc" else "a" for e in edges for x in e}
        assert len(rounds) <= most


def test_a_round_of_components_sends_every_edge_twice(spark):
    """A large and a small step are one shuffle each; no edge is joined to what it was aggregated into."""
    from loomfold.operators import components as G

    edges = spark.range(9_000).select(F.concat(F.lit("n"), F.col("id") + 1).alias("u"), F.concat(F.lit("n"), "id").alias("v"))
    edges = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
    done, hot = G._settled(edges)
    plan = G._closer(G._closer(edges, hot, large=True), hot, large=False)._jdf.queryExecution().executedPlan().toString()
    assert not done and hot is None
    assert plan.count("Exchange hashpartitioning") == 2 and "Join" not in plan


def _two_exports(n, extra=()):
    person = lambda f, p, i: {"_source": f"{f}#{i + 2}", "employee_code": f"{p}{i}", "first_name": f"Name{i}", "last_name": "Surname", "date_of_birth": f"198{i % 10}-01-0{1 + i % 9}"}
    return [person("a.csv", "A", i) for i in range(n)] + [person("b.csv", "B", i) for i in range(n)] + list(extra)


def test_near_duplicates_counted_and_listed_agree(spark):
    rng = random.Random(4)
    items = [{"_source": f"{rng.choice('abc')}.csv#{i}", "employee_code": f"E{i}", "first_name": rng.choice(["Asha", "Ravi"]), "date_of_birth": rng.choice(["1980-01-01", "1990-02-02", ""]),
              "last_name": rng.choice(["Qureshi", "Q.", "Krishnamurthy", "Krishnamurty", "Iyer", ""]), "pan": rng.choice(["", "", "P1", "P2"])} for i in range(80)]
    _, records, _ = resolved(spark, items)
    named = cut(E.name_groups(records, "date_of_birth", "first_name", "last_name", "pan"))
    links = cut(E.near_name_links(named))
    pairs = [(r["key_a"], r["key_b"], r["file_a"], r["file_b"]) for r in E.list_pairs(named, links, chunk=3).collect()]
    assert len({frozenset(p[:2]) for p in pairs}) == len(pairs)

    from loomfold.functions.similarity import weighted_ratio
    def related(a, b):
        x, y = sorted((a["last_name"].strip(".").lower(), b["last_name"].strip(".").lower()), key=len)
        return weighted_ratio(a["last_name"].lower(), b["last_name"].lower()) >= 92 or (x and x != y and len(x) <= 3 and y.startswith(x))
    want = {frozenset((a["employee_code"], b["employee_code"])) for i, a in enumerate(items) for b in items[i + 1:]
            if a["date_of_birth"] and a["date_of_birth"] == b["date_of_birth"] and a["first_name"] == b["first_name"] and not (a["pan"] and a["pan"] == b["pan"]) and related(a, b)}
    assert {frozenset(p[:2]) for p in pairs} == want
    assert E.count_pairs(named, links).agg(F.sum("n_pairs")).collect()[0][0] == len(pairs)
    degree = {r["key"]: r["n_partners"] for r in E.near_duplicate_records(named, links).collect()}
    assert degree == {k: sum(k in p[:2] for p in pairs) for k in {x for p in pairs for x in p[:2]}}
    files = {(r["file_a"], r["file_b"]): r["n_pairs"] for r in E.pairs_by_files(named, links).collect()}
    across = [tuple(sorted(p[2:])) for p in pairs if p[2] != p[3]]
    assert files == {f: across.count(f) for f in set(across)}


def test_open_partners_by_class_are_those_of_the_listed_pairs(spark):
    rng = random.Random(9)
    data = [(f"r{i}", f"K{i}", i, rng.choice(["a", "b", None]), rng.choice(["d1", "d2"]), "x", rng.choice(["krishnamurthy", "krishnamurty", "bo"]), rng.choice(["", "p", "q"])) for i in range(90)]
    named = spark.createDataFrame(data, "_rid string, key string, _seq int, file string, dob string, first string, last string, pan string").withColumn("third", F.col("_seq") % 3)
    links = cut(E.near_name_links(named))
    pairs = [r for r in E.list_pairs(named, links).collect() if (r["seq_a"] + r["seq_b"]) % 3]
    asked = lambda x, y: (x["third"] + y["third"]) % 3 != 0     # noqa: E731
    ends = [r[c] for r in pairs for c in ("rid_a", "rid_b")]
    assert {r["_rid"]: r["n_partners"] for r in E.partners_by_class(named, links, ["third"], asked).collect()} == {x: ends.count(x) for x in ends}
    across = [tuple(sorted((r["file_a"], r["file_b"]))) for r in pairs if r["file_a"] and r["file_b"] and r["file_a"] != r["file_b"]]
    assert {(r["file_a"], r["file_b"]): r["n_pairs"] for r in E.pairs_by_files(named, links, by=["third"], is_open=asked).collect()} == {f: across.count(f) for f in set(across)}


def test_open_partners_lists_no_pair(spark, monkeypatch):
    from workloads import identity

    def listed(*_):
        raise AssertionError("pairs were listed")
    monkeypatch.setattr(E, "list_pairs", listed)
    assert identity.open_partners(spark, "/root/testdata/sf0.001").count()


def test_two_exports_are_one_question_and_merge_all_carries_it_out(spark):
    _, records, members = resolved(spark, _two_exports(20))
    named = cut(E.name_groups(records, "date_of_birth", "first_name", "last_name", "pan"))
    links = cut(E.near_name_links(named))
    flood = E.cross_file_flood(named, links, records).collect()[0]
    assert (flood["subject"], flood["n_pairs"], flood["flood"]) == ("identity-batch:a.csv|b.csv", 20, True)
    edges = E.merge_all_edges(named, links, "a.csv", "b.csv", EMPLOYEE.names)
    merged, moved = E.apply_merges(records.drop("sources"), members, edges, EMPLOYEE)
    assert merged.count() == 20 and merged.where("n_sources <> 2").count() == 0 and moved.select("_rid").distinct().count() == 20
    few = resolved(spark, _two_exports(3, [{"_source": f"c.csv#{i}", "employee_code": f"C{i}"} for i in range(30)]))[1]
    named = cut(E.name_groups(few, "date_of_birth", "first_name", "last_name", "pan"))
    assert not E.cross_file_flood(named, cut(E.near_name_links(named)), few).collect()[0]["flood"]


def test_chained_merge_answers_lose_nobody(spark):
    got, records, members = resolved(spark, [
        {"_source": "a.csv#2", "employee_code": "A", "grade": "L1"}, {"_source": "a.csv#3", "employee_code": "B", "first_name": "Bea"},
        {"_source": "a.csv#4", "employee_code": "C", "last_name": "Cox"}, {"_source": "a.csv#5", "employee_code": "D"}])
    told = answers_frame(spark, {"identity:A|B": "merge:B", "identity:B|C": "merge:C", "identity:C|D": "separate"})
    merged, _ = E.apply_merges(records.drop("sources"), members, E.answered_merges(told, records), EMPLOYEE)
    out = {r["key"]: r for r in merged.collect()}
    assert set(out) == {"C", "D"} and (out["C"]["grade"], out["C"]["first_name"], out["C"]["last_name"], out["C"]["n_sources"]) == ("L1", "Bea", "Cox", 3)


def _graph(spark, pairs):
    return spark.createDataFrame([(a, b, a, a, i) for i, (a, b) in enumerate(pairs)], "work_email string, manager_email string, key string, _rid string, _seq long")


def test_cycles_and_orphans(spark):
    pairs = [("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"), ("e", "d"), ("f", "f"), ("g", "h"), ("h", "g"), ("i", "gone"), ("j", " GONE "), ("k", ""), ("l", "k")]
    pairs += [(f"t{i}", f"t{i + 1}") for i in range(40)] + [(f"w{i}", "a") for i in range(50)] + [(f"r{i}", f"r{(i + 1) % 6}") for i in range(6)]
    df = _graph(spark, pairs)
    graph = cut(reference_graph(df, "work_email", "manager_email"))
    cycles = reference_cycles(graph)
    assert {r["subject"]: r["n_members"] for r in cycle_subjects(cycles, graph).collect()} == {"cycle:a|b|c": 3, "cycle:g|h": 2, "cycle:" + "|".join(f"r{i}" for i in range(6)): 6}
    orphans = orphan_references(df, "work_email", "manager_email")
    assert {r["missing"]: r["n_reports"] for r in orphans.collect()} == {"gone": 2, "t40": 1}
    assert {(r["subject"], r["ref"]) for r in orphan_refs(orphans, df, "manager_email").collect()} == {("manager:gone", "i"), ("manager:gone", "j"), ("manager:t40", "t39")}


def test_the_last_record_speaks_for_a_shared_address(spark):
    graph = reference_graph(_graph(spark, [("a", "b"), ("b", "a"), ("a", "")]), "work_email", "manager_email")
    assert reference_cycles(cut(graph)).count() == 0


def test_salted_lookup_equals_a_left_join(spark):
    big = spark.range(1000).select(F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k"), "id")
    dim = spark.createDataFrame([("hot", 1)] + [(f"k{i}", i) for i in range(40)], "k string, v int")
    hot = spark.createDataFrame([("hot",)], "k string")
    assert sorted(map(tuple, salted_lookup(big, dim, "k", hot, "id").select("k", "id", "v").collect()), key=str) == sorted(map(tuple, big.join(dim, "k", "left").select("k", "id", "v").collect()), key=str)


def test_heavy_keys_take_their_own_path_to_the_same_answer(spark, monkeypatch):
    from loomfold.operators import components as G

    edges = [("hub", f"h{i}") for i in range(200)] + [(f"h{i}", f"k{i}") for i in range(0, 200, 3)] + [("a", "b"), ("b", "c")]
    df = spark.createDataFrame(edges, "a string, b string")
    items = [{"_source": f"a.csv#{i}", "employee_code": "E0" if i % 3 == 0 else f"E{i}", "work_email": f"m{i - i % 2}@x.com"} for i in range(120)]
    plain = {r["node"]: r["component"] for r in G.connected_components(df).collect()}
    rid = lambda: {r["_source"]: r["_rid"] for r in E.resolve_records(rows(spark, items), EMPLOYEE)[1].collect()}      # noqa: E731
    before = rid()
    monkeypatch.setattr(G, "HOT_MINIMUM", 10)
    monkeypatch.setattr(G, "HOT_SHARE", 20)
    assert {r["node"]: r["component"] for r in G.connected_components(df).collect()} == plain
    assert rid() == before


def test_loops_of_merge_answers_keep_one_record(spark):
    pairs = [("a", "b"), ("b", "a"), ("c", "d"), ("d", "e"), ("e", "c"), ("f", "g"), ("g", "h"), ("h", "i"), ("i", "f"), ("x", "c"), ("p", "q"), ("q", "r"), ("p", "z")]
    got = {r["member"]: r["winner"] for r in E.final_winners(spark.createDataFrame(pairs, "member string, winner string")).collect()}
    assert got == {"b": "a", "d": "c", "e": "c", "x": "c", "g": "f", "h": "f", "i": "f", "p": "r", "q": "r"}


def test_a_name_of_a_third_of_all_records_is_listed_in_chunks(spark):
    """Every pair once, whatever the chunks, and one table of the plan's joins for each pair of chunks."""
    people = [("1980-01-01", "asha", "rao" if i % 3 == 0 else ["raoo", "iyer", f"x{i}"][i % 3 if i % 2 else 0], f"r{i:03d}", f"k{i:03d}", "p1" if i % 50 == 0 else "", i, "a") for i in range(240)]
    named = cut(spark.createDataFrame(people, "dob string, first string, last string, _rid string, key string, pan string, _seq int, file string"))
    links = spark.createDataFrame([("1980-01-01", "asha", "rao", "rao", 100.0), ("1980-01-01", "asha", "rao", "raoo", 95.0)], "dob string, first string, value_a string, value_b string, similarity double")
    got = {chunk: sorted((r["rid_a"], r["rid_b"]) for r in E.list_pairs(named, links, chunk).collect()) for chunk in (7, 1_000)}
    rao, other = [p for p in people if p[2] == "rao"], [p for p in people if p[2] == "raoo"]
    fits = lambda a, b: not a[5] or a[5] != b[5]                                # noqa: E731
    want = sorted([(a[3], b[3]) for a in rao for b in rao if a[6] < b[6] and fits(a, b)] + [(a[3], b[3]) for a in rao for b in other if fits(a, b)])
    assert got[7] == got[1_000] == want
