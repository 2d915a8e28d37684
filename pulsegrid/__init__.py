"""Spark-native analytics for declarative biosignal and time-series protocols."""
