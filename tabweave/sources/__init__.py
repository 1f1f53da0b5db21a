"""Delimiter-separated sources and sinks."""
