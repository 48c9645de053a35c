"""Weekly demand analytics on Spark."""
