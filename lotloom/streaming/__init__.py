"""Ingest and board as streams."""
