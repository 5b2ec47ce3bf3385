"""Spark-native analytics over website-crawl data."""
