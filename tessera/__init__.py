"""Tessera: a PySpark-native engine for relational, text and learning-history analytics."""
