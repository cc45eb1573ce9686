"""A PySpark-native page-to-question-and-answer analytics engine."""
