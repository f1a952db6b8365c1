"""Structured Streaming jobs: index sync and update-event flattening."""
