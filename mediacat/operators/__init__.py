"""Operators of the media catalog."""
