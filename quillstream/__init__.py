"""quillstream: a Spark-native content-intelligence engine."""
