"""Structured Streaming forms of the stateless jobs (file streams, stream-static
alignment, checkpointed sinks)."""
