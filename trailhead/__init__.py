"""Journey attribution on Spark: which entry point led signed-in users to start and complete content."""
