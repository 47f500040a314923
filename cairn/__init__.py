"""A PySpark-native engine for a provenance-aware retrieval corpus."""
