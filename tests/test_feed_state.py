import os

import pytest
from pyspark.sql import functions as F

from netsift.operators import indicators as ind
from netsift.sources import feed_state
from netsift.sources.feed_state import FeedState


def values(spark, *items):
    return spark.createDataFrame([(i,) for i in items], "value string")


def at(day):
    return F.lit(f"2026-01-0{day} 00:00:00").cast("timestamp")


def files(root):
    return sorted(os.path.join(d, f) for d, _, fs in os.walk(f"{root}/items") for f in fs if f.endswith(".parquet"))


def found(state, source):
    return {r.value: r.added_at.day for r in state.items([source]).collect()}


def row(state, source):
    return state.state().where(F.col("source") == source).first()


@pytest.fixture
def root(tmp_path):
    return f"{tmp_path}/feeds"


def test_unchanged_feed_leaves_files_and_version(spark, root):
    state = FeedState(spark, root)
    assert state.apply_update("a", "threat_ips", values(spark, "1", "2", "2", None), at(1)) == "changed"
    before, first = files(root), row(state, "a")
    assert state.apply_update("a", "threat_ips", values(spark, "2", "1"), at(2)) == "unchanged"
    again = row(state, "a")
    assert files(root) == before and found(state, "a") == {"1": 1, "2": 1}
    assert (again.version, again.n, again.changes, again.added) == (first.version, 2, 1, 2) and again.updated_at.day == 2


def test_changed_feed_replaces_only_its_source(spark, root):
    state = FeedState(spark, root)
    state.apply_update("a", "threat_ips", values(spark, "1", "2"), at(1))
    state.apply_update("b", "threat_domains", values(spark, "x"), at(1))
    before = files(root)
    reader = FeedState(spark, root)
    assert state.apply_update("a", "threat_ips", values(spark, "2", "3", "4"), at(2)) == "changed"
    assert set(before) < set(files(root))
    assert found(state, "a") == {"2": 2, "3": 2, "4": 2} and found(state, "b") == {"x": 1}
    assert found(reader, "a") == {"1": 1, "2": 1}  # a reader that began earlier keeps its state
    r = row(FeedState(spark, root), "a")
    assert (r.n, r.added, r.removed, r.changes, r.health) == (3, 2, 1, 2, "healthy")
    assert r.version == ind.set_version(values(spark, "2", "3", "4")).first().version


def test_incremental_update_adds(spark, root, monkeypatch):
    monkeypatch.setattr(feed_state, "MAX_GENERATIONS", 2)
    state = FeedState(spark, root)
    state.apply_update("a", "c", values(spark, "1"), at(1), incremental=True)
    for day, new in ((2, "2"), (3, "3"), (4, "4")):
        assert state.apply_update("a", "c", values(spark, "1", new), at(day), incremental=True) == "changed"
    assert state.apply_update("a", "c", values(spark, "1", "4"), at(5), incremental=True) == "unchanged"
    assert found(FeedState(spark, root), "a") == {"1": 1, "2": 2, "3": 3, "4": 4}
    r = row(state, "a")
    assert (r.n, r.added, r.changes, len(r.generations)) == (4, 1, 4, 2)
    assert r.hash == ind.set_version(values(spark, "1", "2", "3", "4")).first().hash


def test_empty_feed_failure_and_removal(spark, root):
    state = FeedState(spark, root)
    assert FeedState(spark, root).items().collect() == [] and state.state().collect() == []
    state.apply_update("a", "c", values(spark, "1"), at(1))
    assert state.apply_update("a", "c", values(spark, "1").limit(0), at(2)) == "changed"
    assert found(state, "a") == {} and row(state, "a").n == 0
    assert state.apply_update("a", "c", values(spark, "1").limit(0), at(3)) == "unchanged"
    state.apply_update("a", "c", values(spark, "5"), at(3))
    assert state.record_failure("a", "timeout", at(4)) == "degraded"
    r = row(FeedState(spark, root), "a")
    assert (r.health, r.error_message, r.n) == ("degraded", "timeout", 1) and found(state, "a") == {"5": 3}
    state.apply_update("a", "c", values(spark, "5"), at(5))
    assert row(state, "a").health == "healthy" and row(state, "a").error_message is None
    assert state.remove("a") and not state.remove("a") and FeedState(spark, root).items().collect() == []
    with pytest.raises(KeyError):
        state.record_failure("a", "gone")


def test_update_that_dies_before_its_commit_changes_nothing(spark, root, monkeypatch):
    state = FeedState(spark, root)
    state.apply_update("a", "c", values(spark, "1"), at(1))
    monkeypatch.setattr(FeedState, "_write_commit", lambda self: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        state.apply_update("a", "c", values(spark, "2"), at(2))
    assert found(FeedState(spark, root), "a") == {"1": 1}
