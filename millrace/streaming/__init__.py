"""Step replay on a stream."""
