"""leafmill: a PySpark-native engine that turns document collections into structured tables."""

__version__ = "0.1.0"
