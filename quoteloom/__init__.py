"""Market-evidence analytics on Spark."""
