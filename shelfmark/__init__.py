"""shelfmark: a PySpark-native retail medallion analytics engine."""
