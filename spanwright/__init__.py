"""Policy-aware span analytics on Spark."""
