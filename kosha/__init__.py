"""Spark-native analytics for funds, securities, bonds and portfolios."""
