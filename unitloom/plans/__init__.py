"""Whole jobs: fact extraction, loading, context assembly, generation with repair."""
