"""operators of caselode."""
