"""Readers and writers: corpora, categories, dictionaries, vectors, pages, reports."""
