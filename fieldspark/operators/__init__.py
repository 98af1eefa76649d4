"""Merging, voting, dedup, completeness, provenance and usage operators."""
