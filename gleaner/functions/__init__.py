"""Column expressions: text handling and relevance arithmetic."""
