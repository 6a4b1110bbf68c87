"""Operators for text corpora and very large identifier or value sets; nothing else in the library imports them."""
