"""Structured Streaming over capture logs."""
