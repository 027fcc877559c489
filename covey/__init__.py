"""Supervised community detection in weighted networks, and text preparation, on Spark."""
