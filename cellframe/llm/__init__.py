"""Operators for large text corpora (training-data preparation).

One module per operator; ``queries`` registers the queries that apply them
to whole tables.  Nothing else in the library imports this subpackage.
"""
