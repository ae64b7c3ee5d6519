"""chatpack streaming."""
