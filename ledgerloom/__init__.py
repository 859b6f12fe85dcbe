"""Marketplace and experiment analytics as Spark DataFrame plans."""
