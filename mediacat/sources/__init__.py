"""Sources of the media catalog."""
