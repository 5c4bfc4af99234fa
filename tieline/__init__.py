"""Organisational analytics over message corpora, written as PySpark DataFrame operators."""
