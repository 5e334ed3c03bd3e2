"""Structured Streaming jobs (I1-I5): incremental ingest with source
precedence, and watermarked N-day means over an event stream."""
