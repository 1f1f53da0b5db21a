"""Relational operators: typed scan, keys, relations, exports."""
