"""Spark-native analytics over album reviews and the artists they cite."""
