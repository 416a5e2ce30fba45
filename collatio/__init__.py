"""collatio: a Spark-native engine that compares a source and a target copy of tables."""

__version__ = "0.1.0"
