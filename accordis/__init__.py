"""Spark-native record consolidation: many descriptions of an entity become one trusted record."""
