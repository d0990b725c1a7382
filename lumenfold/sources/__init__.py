"""Readers and writers of feature, result and metadata tables."""
