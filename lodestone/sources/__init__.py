"""Readers and writers: document folders, ontologies, tables, questions, versions."""
