"""Stateful operators and their Structured Streaming twins."""
