"""operators of the tile engine."""
