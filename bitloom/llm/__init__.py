"""Operators that prepare text for language-model training. Nothing else in bitloom imports this package."""
