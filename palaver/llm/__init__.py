"""Operators for preparing training text: joins, filters, tokenisation, scoring, search and packing."""
