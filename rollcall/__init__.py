"""Record consolidation and training-data preparation on Spark."""
