"""functions of the tile engine."""
