"""Sightline: security-event analytics as Spark jobs."""
