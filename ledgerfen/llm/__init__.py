"""Operators on training text: encoding, leaked evaluation passages, language labels. Nothing outside imports this package."""
