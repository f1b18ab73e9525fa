"""segflow: speech-segment and caption analytics as Spark jobs."""

__version__ = "0.1.0"
