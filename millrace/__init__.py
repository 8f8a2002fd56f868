"""millrace: Spark-native preparation, audit and export of conversational and document data."""

__version__ = "0.1.0"
