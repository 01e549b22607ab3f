"""Chunking: token budgets, title sections, tables, records of a language model."""
