"""Sievemill: curation of instruction data and text corpora as ordinary Spark jobs."""
