"""Structured Streaming: feeds of updates, growing sets of reports, state machines."""
