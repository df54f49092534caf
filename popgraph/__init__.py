"""Spark-native analysis of population time series and of the graphs derived from them."""
