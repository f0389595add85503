"""Relational operators over documents, sentences, scores and claims."""
