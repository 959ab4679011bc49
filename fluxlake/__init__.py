"""Spark-native operators for forecasting from irregular sensor time series."""
