"""Prompt and shell-activity analytics as Spark DataFrame jobs."""
