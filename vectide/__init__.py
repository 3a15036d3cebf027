"""Directional-evidence analytics on Spark, and corpus preparation operators."""
