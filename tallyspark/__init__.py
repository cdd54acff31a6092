"""A transaction-reconciliation analytics engine of PySpark DataFrame operations."""
