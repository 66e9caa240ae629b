"""Column helpers for the source database's NULL, rounding, text and time rules."""
