"""Typed scans of streams: parsing looks at one row only, so it runs on streams unchanged."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..model import Table
from ..operators.scan import Scan, scan_frame


def scan_stream(table: Table, stream: DataFrame) -> Scan:
    """A typed scan of a stream of string columns; keys and row numbers need whole tables."""
    if not stream.isStreaming:
        raise ValueError("not a stream")
    return scan_frame(table, stream)
