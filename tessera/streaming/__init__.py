"""streaming of the tile engine."""
