"""Operators for large training corpora; optional, nothing else in the library imports them."""
