"""Column expressions: text, lists, dates, vocabularies."""
