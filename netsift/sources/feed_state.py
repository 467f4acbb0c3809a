"""Versioned feed state (I1, S12): hash-compared updates of one source at a time.

Two Parquet tables under a folder on shared storage:

- ``items``, partitioned by (source, generation): files that are only ever
  added, never changed;
- ``commits``: each commit is one small file with a row per source, its
  version, hash, counts, health and the generations that make up its items.

Readers go by the latest commit, and an update writes its items before its
commit. So a reader sees a source either before or after an update, other
sources' files stay as they are, and a run that dies before its commit leaves
the state as it was. One writer at a time.

An update is first compared by digest; an unchanged feed writes no items and
keeps its version and counts. A full update of a changed feed starts a new
generation, an incremental one adds a generation with the new items alone.
The commit table has a row per source (tens), which is all the driver reads.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netsift.operators.indicators import set_version

ITEM_SCHEMA = "category string, value string, added_at timestamp, source string, generation string"
STATE_SCHEMA = ("source string, category string, generations array<string>, n bigint, version string, hash string, "
                "digest string, changes bigint, added bigint, removed bigint, health string, error_message string, "
                "updated_at timestamp")
#: Incremental updates after which a source is written as one generation again.
MAX_GENERATIONS = 16


class FeedState:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._number, rows = self._latest()
        self._rows: dict[str, dict] = {r["source"]: r for r in rows}

    def _latest(self) -> tuple[int, list[dict]]:
        commits = self._read("commits", f"{STATE_SCHEMA}, commit bigint")
        number = commits.agg(F.max("commit")).first()[0] if commits is not None else None
        if number is None:
            return 0, []
        rows = commits.where(F.col("commit") == number).drop("commit").collect()
        return number, [r.asDict() for r in rows if r["source"] is not None]

    def _read(self, table: str, schema: str) -> DataFrame | None:
        from pyspark.errors import AnalysisException
        try:
            return self.spark.read.schema(schema).option("basePath", f"{self.root}/{table}").parquet(f"{self.root}/{table}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None  # nothing written yet

    # -- reading ---------------------------------------------------------------------

    def state(self) -> DataFrame:
        """The latest commit: one row per source."""
        return self.spark.createDataFrame([tuple(self._rows[s].values()) for s in sorted(self._rows)], STATE_SCHEMA)

    def items(self, sources: list[str] | None = None) -> DataFrame:
        """Current (source, category, value, added_at); only the named generations' folders are read."""
        wanted = self._rows if sources is None else {s: self._rows[s] for s in sources if s in self._rows}
        return self._items(list(wanted), [g for r in wanted.values() for g in r["generations"]])

    def _items(self, sources: list[str], generations: list[str]) -> DataFrame:
        table = self._read("items", ITEM_SCHEMA)
        if table is None or not generations:
            return self.spark.createDataFrame([], "source string, category string, value string, added_at timestamp")
        return table.where(F.col("source").isin(sources) & F.col("generation").isin(generations)) \
            .select("source", "category", "value", "added_at")

    # -- writing ---------------------------------------------------------------------

    def apply_update(self, source: str, category: str, values: DataFrame, now: Column | None = None,
                     incremental: bool = False) -> str:
        """Make ``values(value)`` the source's items, or add them if ``incremental``; ``changed`` or ``unchanged``.

        A full update stamps all items ``now``, an incremental one the new items.
        Null values are dropped.
        """
        now = F.current_timestamp() if now is None else now
        new = values.select("value").where(F.col("value").isNotNull()).distinct()
        old = self._rows.get(source)
        held = self.items([source]).select("value")
        if incremental and old:
            new = new.join(held, "value", "left_anti")
        generation = uuid.uuid4().hex
        if not incremental and old:
            (fingerprint,) = set_version(new).collect() or [None]
            if (fingerprint["digest"] if fingerprint else None) == old["digest"]:
                return self._commit(source, old | {"health": "healthy", "error_message": None}, now, "unchanged")
        self._write(source, category, generation, new.withColumn("added_at", now.cast("timestamp")))
        written = self._items([source], [generation]).select("value")
        if incremental and old:
            added, removed, generations = written.count(), 0, old["generations"] + [generation]
            if not added:
                return self._commit(source, old | {"health": "healthy", "error_message": None}, now, "unchanged")
        else:
            sides = written.withColumn("new", F.lit(True)).join(held.withColumn("old", F.lit(True)), "value", "full_outer")
            added, removed = sides.agg(F.count(F.when(F.col("old").isNull(), 1)), F.count(F.when(F.col("new").isNull(), 1))).first()
            generations = [generation]
        row = {"source": source, "category": category, "generations": generations, "changes": (old["changes"] if old else 0) + 1,
               "added": added, "removed": removed, "health": "healthy", "error_message": None}
        (found,) = set_version(self._items([source], generations)).collect() or [None]
        known = found.asDict() if found else {"n": 0, "version": None, "hash": None, "digest": None}
        if len(generations) > MAX_GENERATIONS:
            row["generations"] = [self._compacted(source, category, generations)]
        return self._commit(source, row | known, now, "changed")

    def record_failure(self, source: str, error: str, now: Column | None = None) -> str:
        """The source keeps its items and version; its health is ``degraded`` and the error is kept."""
        if source not in self._rows:
            raise KeyError(source)
        self._commit(source, self._rows[source] | {"health": "degraded", "error_message": error[:500]}, now, "")
        return "degraded"

    def remove(self, source: str) -> bool:
        """The next commit is without the source; False if there was none."""
        if self._rows.pop(source, None) is None:
            return False
        self._write_commit()
        return True

    def _write(self, source: str, category: str, generation: str, rows: DataFrame) -> None:
        rows.select(F.lit(category).alias("category"), "value", "added_at", F.lit(source).alias("source"),
                    F.lit(generation).alias("generation")) \
            .write.mode("append").partitionBy("source", "generation").parquet(f"{self.root}/items")

    def _compacted(self, source: str, category: str, generations: list[str]) -> str:
        generation = uuid.uuid4().hex
        self._write(source, category, generation, self._items([source], generations))
        return generation

    def _commit(self, source: str, row: dict, now: Column | None, outcome: str) -> str:
        stamp = F.current_timestamp() if now is None else now
        row = row | {"updated_at": self.spark.range(1).select(stamp.cast("timestamp")).first()[0]}
        self._rows[source] = {c.split()[0]: row.get(c.split()[0]) for c in STATE_SCHEMA.split(", ")}
        self._write_commit()
        return outcome

    def _write_commit(self) -> None:
        self._number += 1
        mark = self.spark.createDataFrame([(None,) * len(STATE_SCHEMA.split(", "))], STATE_SCHEMA)  # a commit may have no sources
        self.state().unionByName(mark).coalesce(1).write.mode("error").parquet(f"{self.root}/commits/commit={self._number}")
