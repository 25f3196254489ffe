"""Event processing on Structured Streaming, with batch forms of the same rules."""
