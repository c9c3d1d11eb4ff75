"""sources of caselode."""
