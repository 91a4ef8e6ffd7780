"""Ledgers, activity, delivery and search over records of AI-assisted work, as Spark DataFrame operations."""
