"""sources of the tile engine."""
