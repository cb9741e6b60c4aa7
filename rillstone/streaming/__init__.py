"""Change streams, event clocks and Structured Streaming runners."""
