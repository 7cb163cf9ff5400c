"""Structured Streaming: vintages that arrive as a stream of files."""
