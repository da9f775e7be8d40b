"""Structured Streaming: extensions beyond what the batch operators do."""
