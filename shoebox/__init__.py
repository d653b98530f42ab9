"""Media-library reconciliation on Spark."""
