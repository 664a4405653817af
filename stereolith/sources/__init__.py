"""stereolith.sources."""
