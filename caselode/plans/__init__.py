"""plans of caselode."""
