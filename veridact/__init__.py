"""Veridact: a PySpark-native engine for querying and scoring linked evidence."""
