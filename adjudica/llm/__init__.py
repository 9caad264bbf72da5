"""Operators for preparing training data at scale.

Nothing else in the library imports this subpackage; the queries that apply its operators to whole
tables are in :mod:`adjudica.llm.queries`.
"""
