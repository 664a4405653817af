"""stereolith.operators."""
