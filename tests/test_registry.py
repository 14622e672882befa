"""Every registered query against its SQL twin on the small tables."""

import glob
import os

import pytest

import __spark_entry__ as entry
from marlstone import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
duckdb = pytest.importorskip("duckdb")
if not os.path.isdir(SF):
    pytest.skip("no test tables", allow_module_level=True)


@pytest.fixture(scope="module")
def tables():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(x):
    if x is None or x != x:
        return None
    if isinstance(x, bool):
        return str(x)
    return f"{x:.6f}" if isinstance(x, (int, float)) else str(x).removesuffix("+00:00")


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_twin(spark, tables, name):
    got = registry.queries()[name](spark, SF)
    rows = tables.execute(registry.oracle_sql()[name])
    names = [d[0] for d in rows.description]
    assert sorted(names) == sorted(got.columns)
    order = sorted(names)
    mine = [tuple(plain(r[c]) for c in order) for r in got.collect()]
    key = lambda t: tuple((x is None, x or "") for x in t)
    theirs = [tuple(plain(r[names.index(c)]) for c in order) for r in rows.fetchall()]
    assert sorted(mine, key=key) == sorted(theirs, key=key)


def test_log_rows_whole_differ_from_the_twin_only_in_the_tied_last_places(spark, tmp_path):
    """From 120000 documents on rows share resource and time, and the twin leaves open which of them come within its limit."""
    c = duckdb.connect()
    c.execute("CREATE TABLE documents AS SELECT range AS doc_id, 'text ' || range AS text, 'en' AS lang, 'src1' AS source, 10::BIGINT AS n_chars FROM range(250000)")
    c.execute(f"COPY documents TO '{tmp_path}/documents.parquet' (FORMAT parquet)")
    sql, limit = registry.oracle_sql()["log_rows_whole"], 500
    assert sql.endswith(f" LIMIT {limit}")
    rows = c.execute(sql.removesuffix(f" LIMIT {limit}"))
    names = [d[0] for d in rows.description]
    whole = rows.fetchall()
    key = lambda r: (r[names.index("resource_id")], r[names.index("observed_at")])
    last = key(whole[limit - 1])
    tied = {r for r in whole if key(r) == last}
    before = [r for r in whole[:limit] if key(r) != last]
    assert len(before) + len(tied) > limit
    got = registry.queries()["log_rows_whole"](spark, str(tmp_path))
    mine = [tuple(r[n] for n in names) for r in got.collect()]
    assert sorted(got.columns) == sorted(names) and len(mine) == len(set(mine)) == limit
    assert set(mine[:len(before)]) == set(before) and list(map(key, mine)) == list(map(key, whole[:limit]))
    assert set(mine[len(before):]) < tied
    # of tied rows the first by ingested_at, severity and body, each time
    rest = [names.index(n) for n in ("ingested_at", "severity", "body")]
    assert mine[len(before):] == sorted(tied, key=lambda r: [r[i] for i in rest])[:limit - len(before)]


def test_every_query_has_a_twin():
    assert set(registry.queries()) == set(registry.oracle_sql())


def test_stored_tables_are_pruned_and_filtered_at_the_scan(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    plan = registry.queries()["log_severity_gte"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(tenant_id" in plan and "(d#" in plan and "PushedFilters: [IsNotNull(observed_at)" in plan and "In(severity" in plan
    assert "body" not in plan.split("ReadSchema")[1].split("\n")[0]
    assert "logs_counts_5m" in registry.queries()["log_histogram"](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
