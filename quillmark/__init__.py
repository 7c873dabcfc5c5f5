"""quillmark: a Spark-native engine for governed Markdown notes."""

__version__ = "0.2.0"
