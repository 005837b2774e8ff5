"""Structured Streaming forms of the stateful operators (ST1-ST3)."""
