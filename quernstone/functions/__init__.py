"""Column expressions."""

from quernstone.functions.text import words

__all__ = ["words"]
