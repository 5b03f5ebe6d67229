"""Whole jobs (ingest, training, scoring, history) and the registered queries."""
