"""Streaming counterparts of the time-bucket operators."""
