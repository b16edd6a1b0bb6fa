"""Functions of the media catalog."""
