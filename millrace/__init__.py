"""Spark-native data preparation: operators, reports and step replay."""
