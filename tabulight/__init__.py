"""Automatic table analysis on Spark: types, quality, statistics, segments, trends, findings."""
