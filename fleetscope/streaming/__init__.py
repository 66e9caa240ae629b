"""Streaming forms of the sample reports, and a run-to-end helper."""
