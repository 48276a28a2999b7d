"""Every registered query with a SQL twin, on the smallest given tables."""

import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
# the rest runs with LOOMFOLD_ALL=1 (and in verify.py)
QUICK = {"row_provenance", "csv_provenance", "normalise_values", "split_names", "read_dates", "date_convention", "mask_columns", "document_entities", "shared_id_conflict", "orphan_references",
         "apply_merges", "candidate_scores", "validate_rows", "repair_rows", "load_outcomes", "plan_buckets", "value_rules", "dedupe_questions", "audit_counts",
         "open_partners", "near_duplicate_records", "pending_fields", "name_order", "cosmetic_changes", "reference_answers", "breaker",
         "record_sources", "cycle_members", "weighted_scores", "questions_words", "questions_references", "questions_batch", "push_audit", "merge_all_edges"}
QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="session")
def duck():
    import duckdb
    from workloads.inputs import TABLES

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_every_oracle_belongs_to_a_query():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.skipif(not os.path.isdir(SF), reason="given tables not present")
@pytest.mark.parametrize("name", sorted(ORACLE if os.environ.get("LOOMFOLD_ALL") else QUICK))
def test_query_equals_sql(spark, duck, name):
    from verify import rows_of

    df = QUERIES[name](spark, SF)
    cur = duck.execute(ORACLE[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(names, cur.fetchall())
