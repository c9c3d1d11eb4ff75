"""functions of caselode."""
