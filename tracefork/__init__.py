"""Failed-trace analytics on Spark: token divergence features, junctions, steering replays and routing."""

__version__ = "0.1.0"
