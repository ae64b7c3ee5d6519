"""chatpack operators."""
