"""Structured Streaming forms of span merging and chunk packing."""
