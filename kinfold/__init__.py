"""Entity resolution on Spark."""
