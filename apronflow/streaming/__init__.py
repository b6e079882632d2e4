"""Structured Streaming versions of the alert rules and history sinks."""
