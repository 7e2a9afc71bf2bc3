"""Similarity retrieval over feature vectors as DataFrame plans."""
