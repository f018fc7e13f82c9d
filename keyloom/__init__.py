"""keyloom: a Spark-native engine for versioned, ordered key-value data."""

__version__ = "0.1.0"
