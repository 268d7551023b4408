"""quillstone: a Spark-native engine for document analytics and structured record extraction."""

__version__ = "0.1.0"
