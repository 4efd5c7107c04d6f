"""Column-level text algebra."""
