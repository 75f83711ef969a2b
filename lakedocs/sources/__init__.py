"""Readers, writers and checks at the edge of the corpus."""
