"""Corpus-building operators: quality, mixing, duplicates, packing, search, language and licences."""
