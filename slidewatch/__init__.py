"""Segment conversion analytics as Spark DataFrame jobs."""
