"""Standing jobs on Structured Streaming."""
