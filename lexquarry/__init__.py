"""Grounded document analytics as Spark plans."""
