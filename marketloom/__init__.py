"""Market-microstructure analytics on Spark."""
