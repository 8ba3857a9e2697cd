"""Readers and writers of record tables, truth lists, result lists and run summaries."""
