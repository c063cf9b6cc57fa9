"""Decide one attribute of a venue from free-text evidence, as Spark DataFrame jobs."""
