"""Entity-and-episode telemetry on Spark: frames, alignment, corpora, scoring."""

__version__ = "0.1.0"
