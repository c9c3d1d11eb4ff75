"""streaming of caselode."""
