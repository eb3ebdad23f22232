"""The query catalogue: Spark plans and the SQL they are checked against."""
