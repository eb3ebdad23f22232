"""Streaming views over append-only logs."""
