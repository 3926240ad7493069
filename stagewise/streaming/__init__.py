"""Streaming counterparts of the polling processors."""
