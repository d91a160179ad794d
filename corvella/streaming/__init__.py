"""Change watchers on Structured Streaming."""
