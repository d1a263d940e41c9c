"""Spark-first engine for learning and applying subword segmentation from parallel text."""

__version__ = "0.1.0"
