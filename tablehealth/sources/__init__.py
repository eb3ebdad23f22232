"""Readers, segment providers, catalog adapters and the append-only store."""
