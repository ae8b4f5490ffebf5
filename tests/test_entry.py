"""The entry module: queries run on the smallest tables and agree with their SQL twins."""

import decimal
import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tidewell.plans import catalogue

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        path = f"{DIR}/{t}.parquet"
        c.execute(f"create view {t} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return c


def norm(v):
    if isinstance(v, decimal.Decimal):
        return str(v.normalize()) if v else "0"
    return repr(round(v, 9) + 0.0) if isinstance(v, float) else str(v)


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_query_equals_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, DIR)
    columns = sorted(df.columns)
    got = sorted(tuple(norm(r[c]) for c in columns) for r in df.collect())
    result = duck.execute(catalogue.ORACLE[name])
    names = [x[0] for x in result.description]
    assert sorted(names) == columns
    want = sorted(tuple(norm(r[names.index(c)]) for c in columns) for r in result.fetchall())
    assert got == want


def test_no_query_of_the_core_needs_the_llm_folder():
    for path in glob.glob(os.path.join(os.path.dirname(entry.__file__), "tidewell", "**", "*.py"), recursive=True):
        if f"{os.sep}llm{os.sep}" not in path:
            assert "tidewell.llm" not in open(path).read(), path


def test_red_baseline_of_cohorts_whose_first_click_has_no_status(spark, tmp_path):
    at = "timestamp '2024-01-01' + interval {} hour"
    of = [(1, [(0, "click"), (1, "error"), (2, "click")]), (2, [(0, "click"), (1, "view"), (2, "click")]), (3, [(0, "click"), (1, "click"), (2, "click")]), (4, [(0, "click"), (1, "error"), (2, "click"), (3, "view"), (4, "click")])]
    rows = ", ".join(f"({user * 10 + h}::BIGINT, {at.format(h)}, {user}::BIGINT, '{kind}', 1.0::DOUBLE, '{{}}')" for user, events in of for h, kind in events)
    c = duckdb.connect()
    c.execute(f"create table events as select * from (values {rows}) t(event_id, ts, user_id, event_type, value, props)")
    c.execute(f"copy events to '{tmp_path}/events.parquet' (format parquet)")
    df = catalogue.QUERIES["red_baseline_cohorts"](spark, str(tmp_path))
    got = sorted(tuple(r) for r in df.select("user_id", "cohort", "width", "status").collect())
    assert got == [(1, 1, 2, "error"), (3, 1, 3, "absent"), (4, 1, 3, "error")]
    assert got == sorted(c.execute(catalogue.ORACLE["red_baseline_cohorts"]).fetchall())


@pytest.mark.parametrize("name", ["synthesis_pass", "nightly_digest"])
def test_detectors_look_through_the_events_once(spark, name):
    files = catalogue.QUERIES[name](spark, DIR).inputFiles()
    of = [f for f in files if "/hits/" in f]
    assert of and not [f for f in files if "events.parquet" in f and name == "synthesis_pass"]
