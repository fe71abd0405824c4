"""Listing analytics on Spark: DataFrame operators for pages, listings, comparisons, jobs and events."""
