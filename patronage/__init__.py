"""Customer-lifecycle analytics on Spark: retention, repeat purchase, revenue, activation."""
