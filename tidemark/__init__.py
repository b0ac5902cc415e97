"""tidemark: a Spark-native engine for relational decision-support queries."""

__version__ = "0.1.0"
