"""Terrain and network analytics as Spark DataFrame programs."""
