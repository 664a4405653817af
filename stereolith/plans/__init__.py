"""stereolith.plans."""
