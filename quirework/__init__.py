"""Document-layout and text operators on Spark DataFrames."""

__all__ = ["functions", "operators", "plans", "sources", "streaming"]
