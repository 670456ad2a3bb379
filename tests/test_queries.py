"""Every core query against its SQL, and results that do not depend on the number of partitions."""

import pytest
from oracle import assert_equal

from entityflow import queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_against_sql(spark, name):
    assert_equal(queries.QUERIES[name](spark, DATA), queries.SQL[name], DATA)


def test_entry_has_rows_and_no_python(spark):
    import __spark_entry__

    frame = __spark_entry__.entry(spark)
    assert frame.count() > 0
    assert "Python" not in frame._jdf.queryExecution().toString()


@pytest.mark.parametrize("name", ["handoff_select", "repeated_results_stop", "audit_sample_hash", "source_gate_join"])
def test_partitions_do_not_matter(spark, name):
    seen = []
    for n in ("1", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        seen.append(sorted(map(str, queries.QUERIES[name](spark, DATA).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert seen[0] == seen[1]


def test_resolve_pages_decides_every_page_once(spark):
    rows = queries.QUERIES["resolve_pages"](spark, DATA).collect()
    assert len(rows) == 50 and {r["status"] for r in rows} <= {"pending", "skipped", "confirmed"}


@pytest.mark.parametrize("name", ["repeated_results_stop", "seen_filter"])
def test_all_events_take_part(spark, name):
    """sf0.01 has events of many more ids than sf0.001: the operators and their SQL read them all."""
    assert_equal(queries.QUERIES[name](spark, "/root/testdata/sf0.01"), queries.SQL[name], "/root/testdata/sf0.01")
