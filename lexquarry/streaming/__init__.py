"""Stateful streaming operators and their batch twins."""
