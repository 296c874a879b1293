"""tidesmith: a PySpark-native engine for ordered signals, their scoring, and evaluation data-flow."""

__version__ = "0.1.0"
