"""Registered queries over the driver's tables (see ``rankspark.registry``)."""

from rankspark.queries import adhoc, compare, dashboard, ingest, keywords, measures, reports, rollup, store  # noqa: F401
