"""Spark-first analytics engine for outbreak notifications and news."""
