"""Spark-native analytics for typed, probabilistic decisions and for the text data behind them."""
