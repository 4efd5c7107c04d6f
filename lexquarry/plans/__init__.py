"""Queries over whole tables, built from the operators."""
