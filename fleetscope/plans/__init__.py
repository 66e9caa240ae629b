"""Bindings: reports over source sections, and the same operators over the test tables."""
