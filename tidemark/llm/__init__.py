"""Operators on training text: packing into containers, leaked evaluation texts, abusive content."""
