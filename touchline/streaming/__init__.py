"""Structured Streaming versions of landing, event statistics and team state."""
