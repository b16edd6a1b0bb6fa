"""Plans of the media catalog."""
