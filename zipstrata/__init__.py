"""Archive deltas and corpus operators on Spark."""
