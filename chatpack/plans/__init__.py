"""chatpack plans."""
