"""Operators that prepare text collections for language-model training; nothing else in the library imports them."""
