"""The registered queries over the event, sensor and archive operators, and their SQL.

Names map to (query, SQL); SQL is None where only a test against a plain model can check the query."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewatch.plans import annotation_queries, archive_queries, audit_queries, display_queries, event_queries, ingest_queries, motion_queries, repair_queries, sensor_queries, stream_queries

FLAGSHIP = "linked_events"
ENTRIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = event_queries.ENTRIES | sensor_queries.ENTRIES | archive_queries.ENTRIES | stream_queries.ENTRIES | display_queries.ENTRIES | repair_queries.ENTRIES | ingest_queries.ENTRIES | audit_queries.ENTRIES | annotation_queries.ENTRIES | motion_queries.ENTRIES
QUERIES = {name: query for name, (query, _) in ENTRIES.items()}
ORACLE = {name: sql for name, (_, sql) in ENTRIES.items() if sql}
