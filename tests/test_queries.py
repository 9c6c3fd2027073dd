"""Each registered query of the telemetry engine against DuckDB at the smallest scale."""

from __future__ import annotations

import os
from datetime import datetime, timedelta, timezone

import pytest

from gaugeworks.plans import catalog
from tests.duck import assert_same, views

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLE_SQL)


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query_matches_sql(spark, name):
    found = catalog.QUERIES[name](spark, SF_DIR).toPandas()
    assert len(found)
    assert_same(found, views(SF_DIR).sql(catalog.ORACLE_SQL[name]).df())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(catalog.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_derived_tables_follow_their_source(spark, tmp_path):
    """A source whose files change isn't answered from tables that were stored before."""
    events = spark.read.parquet(f"{SF_DIR}/events.parquet")
    counts = []
    for n in (40, 70):
        events.where(f"event_id < {n}").write.mode("overwrite").parquet(f"{tmp_path}/events.parquet")
        counts.append([catalog.QUERIES[q](spark, str(tmp_path)).first()[0] for q in ("total_count", "sql_count_by_machine")][0])
        assert catalog.QUERIES["latest_overall"](spark, str(tmp_path)).first()["id"] is not None
    assert counts == [40, 70]


def test_freshness_after_a_long_ingest(spark, monkeypatch):
    """A flush counts by the clock as it stands when the ingest is over, however long that took; all ages are returned."""
    begun = datetime.now(timezone.utc).replace(tzinfo=None)
    clock = {"now": begun}

    class Clock(datetime):
        @classmethod
        def now(cls, tz=None):
            return clock["now"].replace(tzinfo=tz)

    def ingested(s, d):  # noqa: ANN001
        clock["now"] = begun + timedelta(minutes=10)

    late = spark.createDataFrame([(begun + timedelta(minutes=9),)], "flushed_at timestamp_ntz")
    monkeypatch.setattr(catalog, "datetime", Clock)
    monkeypatch.setattr(catalog.derived, "ingested", ingested)
    monkeypatch.setattr(catalog.ingest, "ingest_batches", lambda s, t: late)
    found = catalog.QUERIES["freshness"](spark, SF_DIR).first()
    assert found["flushed_lately"]
    assert found["last_flush"] <= found["last_ts"] and found["flush_age_s"] >= found["age_s"]
    late = late.limit(0)
    assert not catalog.QUERIES["freshness"](spark, SF_DIR).first()["healthy"]


def test_lookups_read_no_history(spark):
    """Lookups of the newest rows read what is kept of them, and no plan of theirs has a join."""
    for name in ("latest_by_machine", "latest_readings_by_sensor", "latest_overall", "machine_stats", "fleet_stats", "compacted_lookup"):
        found = catalog.QUERIES[name](spark, SF_DIR)
        assert all("/newest/" in f or "/newest_readings/" in f for f in found.inputFiles()) and found.inputFiles(), name
        assert "Join" not in found._jdf.queryExecution().executedPlan().toString(), name
