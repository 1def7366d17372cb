"""Structured Streaming variants: job states and attribution as chunks arrive."""
