"""plans of the tile engine."""
