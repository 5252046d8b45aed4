"""Operators of a training-data pipeline over the tables documents, embeddings, pages, benchmark and labels.

Nothing else in the library imports this package. Queries and their SQL are in ``queries``.
"""
