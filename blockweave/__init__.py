"""blockweave: still-image coding as DataFrame processing on Spark."""

__version__ = "0.1.0"
