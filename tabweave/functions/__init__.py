"""Column expressions: datatypes, number and date formats, URI templates."""
