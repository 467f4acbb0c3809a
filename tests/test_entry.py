"""The driver contract: entry(), queries(), oracle_sql()."""

import __spark_entry__ as se
from conftest import SF0001


def test_entry_runs(spark):
    df = se.entry(spark)
    assert len(df.columns) > 0
    assert df.count() >= 0


def test_oracle_keys_are_queries():
    qs, orc = se.queries(), se.oracle_sql()
    assert set(orc) <= set(qs)
    assert len(qs) >= 80


def test_every_query_builds_at_sf0001(spark):
    qs = se.queries()
    for name in ["traffic_summary", "detect_port_scan", "graph_edges_full", "feed_json_items", "anomaly_top"]:
        assert qs[name](spark, SF0001).count() >= 0
