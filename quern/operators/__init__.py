"""Relational operators, one module per family of the inventory."""
