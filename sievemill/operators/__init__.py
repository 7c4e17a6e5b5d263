"""Operators on DataFrames: sampling, requests, scoring, similarity, deduplication, coverage, diversity."""
