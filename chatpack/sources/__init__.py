"""chatpack sources."""
