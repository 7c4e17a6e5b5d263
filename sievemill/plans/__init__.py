"""Whole plans: the curation run and the registered queries."""
