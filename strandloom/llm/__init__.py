"""Operators of a training-data pipeline: tokenizing, filtering, deduplicating and mixing text."""
