"""Operators: DataFrame -> DataFrame jobs (upsert, dedupe, enrich, search, audit, export, HTML)."""
