"""Operators for text corpora: linking new batches, main text of pages, tokens, packing, languages.

Nothing outside this subpackage imports it.
"""
