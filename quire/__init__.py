"""Corpus analytics on Spark: ingest, joins, hierarchies, markup, sync and sinks as DataFrame transformations."""
