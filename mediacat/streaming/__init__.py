"""Streaming of the media catalog."""
