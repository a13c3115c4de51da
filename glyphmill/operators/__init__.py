"""Relational operators: geometry, pixels, naming, palettes, catalogue."""
