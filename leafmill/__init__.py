"""Document-layout and training-data analytics on Spark."""
