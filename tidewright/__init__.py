"""Spark-first analytics engine for time-stamped market and decision data."""
