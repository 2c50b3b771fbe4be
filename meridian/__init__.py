"""Meridian: discovery analytics and corpus processing as Spark jobs."""
