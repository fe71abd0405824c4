"""All registered queries and their SQL."""

from __future__ import annotations

from .plans import comparing, crawling, exporting, hints, jobs, merging, normalizing, registry, scoring, validating  # noqa: F401

FLAGSHIP = "k7_configuration_table"
QUERIES = registry.QUERIES
ORACLES = registry.ORACLES
