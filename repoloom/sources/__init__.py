"""Readers and writers: corpora, listings, catalogues, rewritten files."""
