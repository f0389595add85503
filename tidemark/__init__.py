"""Aspect-sentiment document analytics as Spark DataFrame plans."""
