"""Vector analytics on Spark."""
