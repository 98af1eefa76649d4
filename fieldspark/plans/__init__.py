"""Schema algebra, chunk planning, the extraction engine and its extractors."""
