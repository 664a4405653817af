"""stereolith: multi-view reconstruction tables as Spark jobs."""
