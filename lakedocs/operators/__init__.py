"""Operators on tables of documents, blocks, chunks, vectors, questions and hits."""
