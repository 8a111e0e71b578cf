"""sedimark: a PySpark-native engine for code retrieval, static analysis and text-corpus preparation."""

__version__ = "0.1.0"
