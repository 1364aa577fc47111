"""sigloom: a PySpark-native engine for multi-entity time-series analytics and data preparation."""

__version__ = "0.1.0"
