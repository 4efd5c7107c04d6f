"""Readers that turn files into located text segments."""
