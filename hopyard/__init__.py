"""Hopyard: a PySpark-native engine for messy, multi-source records about places."""
