"""Column functions: reply parsing, shingles and signatures, embeddings."""
