"""Cost-aware ranking and selection on Spark."""
