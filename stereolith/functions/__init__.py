"""stereolith.functions."""
