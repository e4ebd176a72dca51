"""Operators for preparing training text: filters, de-duplication, scoring, search and mixing."""
