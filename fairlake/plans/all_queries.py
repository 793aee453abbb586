"""Loads every query module so that the registry is complete."""

from fairlake.plans import (  # noqa: F401
    catalog_queries,
    history_queries,
    lifecycle_queries,
    listing_queries,
    manifest_queries,
    oplog_queries,
    path_queries,
    record_queries,
    stream_queries,
    validation_queries,
)
from fairlake.plans.registry import ORACLES, QUERIES  # noqa: F401
