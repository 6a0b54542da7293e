"""Evidence search, verification and data preparation on Spark."""
