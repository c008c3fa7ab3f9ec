"""Records that arrive as a stream."""
