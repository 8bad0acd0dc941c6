"""Relational operators of the edition, enrichment, views and operational logs."""
