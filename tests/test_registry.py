"""The registered queries as a whole."""

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SAMPLE = ["fold_lines", "rule_validation", "payload_shape", "cascade_match", "collapse_runs", "visual_order", "word_reuse", "sheet_rules", "enriched_fields", "orphans",
          "path_conflicts", "assign_section"]


def test_names_and_sql_belong_together():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 150


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns and df.count() > 0


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql(spark, duck, name):
    from tools.check import canonical
    df = entry.queries()[name](spark, SF)
    cursor = duck.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert canonical([tuple(r) for r in df.collect()], df.columns) == canonical(cursor.fetchall(), columns)


def test_lookups_plan_without_cross_joins(spark):
    for name in ("cascade_match", "path_conflicts", "fuzzy_names", "near_points"):
        plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


@pytest.mark.parametrize("name", ["collapse_runs", "visual_order", "merge_adjacent", "suffix_by_row", "resolve_collisions", "dedupe_across_docs", "sections_logical", "radio_groups",
                                  "interleave_prefilled", "enriched_fields", "positional_pairs", "events_after_signup", "reading_order", "speaker_runs", "ficha_index", "sample_tree"])
def test_ordered_work_stays_in_slices(spark, name):
    """no window sorts a whole key: each one is cut by a slice, or runs over slice totals"""
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows and all("_slice" in line for line in windows), [w for w in windows if "_slice" not in w]
