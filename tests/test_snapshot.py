"""The indicator snapshot (S12) comes back whole."""

from conftest import SF0001

from netsift.plans import catalog
from netsift.sources.flows import load_tables


def test_snapshot_round_trip_returns_every_source(spark):
    got = catalog.queries()["indicator_snapshot_roundtrip"](spark, SF0001)
    want = catalog._out(catalog.base_indicators(load_tables(spark, SF0001)))
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    feeds = {r["source"] for r in catalog.base_feeds(load_tables(spark, SF0001)).collect()}
    assert {r["source"] for r in got.select("source").distinct().collect()} == feeds
