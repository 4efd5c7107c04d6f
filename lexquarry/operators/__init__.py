"""Document, retrieval, grounding and relational operators."""
