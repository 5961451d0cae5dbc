"""Retrieval and text analytics as DataFrame operators on Spark."""
