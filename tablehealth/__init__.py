"""Physical health of tables, computed as Spark plans."""
