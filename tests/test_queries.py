"""The engine's queries against their SQL, on the smallest of the driver's tables."""

import os

import duckdb
import pytest

from synapta.plans import queries as plans

FOLDER = os.environ.get("SYNAPTA_TEST_TABLES", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables here")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    return c


def canonical(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    show = lambda v: f"{v:.6g}" if isinstance(v, float) else str(v)
    return sorted(names), sorted(tuple(show(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_query_equals_sql(spark, con, name):
    df = plans.QUERIES[name](spark, FOLDER)
    want = con.execute(plans.SQL[name])
    assert canonical(df.columns, df.collect()) == canonical([d[0] for d in want.description], want.fetchall())


def test_a_context_for_every_text(spark):
    rows = plans.injected_contexts(spark, FOLDER).collect()
    assert len(rows) == spark.read.parquet(f"{FOLDER}/benchmark.parquet").count()
    assert all(r.context.startswith("Current time: [2024-06-01 12:00]\n--- Injected Context ---\n• ") for r in rows)


def test_filters_and_columns_reach_the_scan(spark):
    plan = spark.read.parquet(f"{FOLDER}/documents.parquet").where("lang = 'en'").select("doc_id")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(lang), EqualTo(lang,en)]" in plan
    scan = plans.token_counts(spark, FOLDER)._jdf.queryExecution().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in scan


def test_statements_of_all_events_are_merged(spark):
    users = {r.user_id for r in spark.read.parquet(f"{FOLDER}/events.parquet").select("user_id").distinct().collect()}
    s = plans.event_statements(spark, FOLDER).collect()
    assert len(s) == spark.read.parquet(f"{FOLDER}/events.parquet").count() and {int(r.content.split()[0][4:]) for r in s} == users
    rows = plans.merged_statements(spark, FOLDER).collect()
    assert len(rows) == len({r.id for r in rows}) and {r.id for r in rows} >= {r.id for r in s if r.seq % 2 == 0}
    assert sum(r.verifications == 1 and r.previous_content is not None for r in rows) > 0


def test_structural_clusters_read_whole_texts(spark, monkeypatch):
    monkeypatch.setattr(plans.clusters, "subject_clusters", lambda b: b)
    assert max(len(r.content) for r in plans.structural_clusters(spark, FOLDER).select("content").collect()) > 100
