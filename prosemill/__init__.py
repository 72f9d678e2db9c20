"""Text and code quality analytics on Spark."""
