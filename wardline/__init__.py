"""Prompt-security analytics as Spark jobs."""
