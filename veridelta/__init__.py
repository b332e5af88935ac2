"""Change-evidence analytics on Spark."""
