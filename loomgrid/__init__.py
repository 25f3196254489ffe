"""Spark-native grid and event analytics: DataFrame operators, sources, plans and streams."""
