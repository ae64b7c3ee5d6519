"""chatpack functions."""
