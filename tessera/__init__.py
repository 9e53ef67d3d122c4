"""tessera: align, fuse and query tiled images with Spark DataFrames."""

__all__ = ["functions", "operators", "plans", "sources", "streaming"]
