"""How a delimited file is written."""

from __future__ import annotations

import codecs
import re
import warnings
from dataclasses import dataclass, fields, replace
from typing import Any

#: Properties of a description and their fields; fixed names.
PROPERTIES = {
    "encoding": "encoding",
    "lineTerminators": "line_terminators",
    "quoteChar": "quote_char",
    "doubleQuote": "double_quote",
    "skipRows": "skip_rows",
    "commentPrefix": "comment_prefix",
    "header": "header",
    "headerRowCount": "header_row_count",
    "delimiter": "delimiter",
    "skipColumns": "skip_columns",
    "skipBlankRows": "skip_blank_rows",
    "skipInitialSpace": "skip_initial_space",
    "trim": "trim",
}


@dataclass(frozen=True)
class Dialect:
    encoding: str = "utf-8"
    line_terminators: tuple[str, ...] = ("\r\n", "\n")
    quote_char: str | None = '"'
    double_quote: bool = True
    skip_rows: int = 0
    comment_prefix: str | None = "#"
    header: bool = True
    header_row_count: int = 1
    delimiter: str = ","
    skip_columns: int = 0
    skip_blank_rows: bool = False
    skip_initial_space: bool = False
    trim: str = "false"

    @classmethod
    def of(cls, v: Any, described: bool = False) -> Dialect:
        """From properties; what is not valid is warned about and left at its default."""
        if isinstance(v, cls):
            return v
        start = cls(comment_prefix=None) if described else cls()
        good: dict[str, Any] = {}
        if v is not None and not isinstance(v, dict):
            warnings.warn(f"not a dialect: {v!r}", stacklevel=2)
            v = {}
        if (v or {}).get("@type", "Dialect") != "Dialect":
            raise ValueError(f"@type of a Dialect is {v['@type']!r}")
        for key, value in (v or {}).items():
            if key.startswith("@"):
                continue
            name = PROPERTIES.get(key, key)
            if name not in {f.name for f in fields(cls)}:
                warnings.warn(f"unknown dialect property: {key}", stacklevel=2)
                continue
            try:
                good[name] = cls._valid(name, value)
            except (ValueError, TypeError, LookupError):
                warnings.warn(f"not a value of {key}: {value!r}", stacklevel=2)
        if "header_row_count" in good and "header" not in good and good["header_row_count"]:
            good["header"] = True
        return replace(start, **good)

    @staticmethod
    def _valid(name: str, value: Any) -> Any:
        if name in ("skip_rows", "skip_columns", "header_row_count"):
            if isinstance(value, bool) or int(value) != value or value < 0:
                raise ValueError(value)
            return int(value)
        if name in ("double_quote", "header", "skip_blank_rows", "skip_initial_space"):
            if not isinstance(value, bool):
                raise ValueError(value)
            return value
        if name == "trim":
            text = str(value).lower()
            if text not in ("true", "false", "start", "end"):
                raise ValueError(value)
            return text
        if name == "line_terminators":
            return (value,) if isinstance(value, str) else tuple(value)
        if name == "encoding":
            codecs.lookup("utf-8-sig" if value.lower() == "utf-8-bom" else value)
            return value
        if name in ("quote_char", "comment_prefix"):
            if value is not None and (not isinstance(value, str) or not value):
                raise ValueError(value)
            return value
        if name == "delimiter" and (not isinstance(value, str) or len(value) != 1):
            raise ValueError(value)
        return value

    def updated(self, **changes: Any) -> Dialect:
        return Dialect.of({**self.asdict(full=True), **changes})

    @property
    def python_encoding(self) -> str:
        name = self.encoding.lower()
        return "utf-8-sig" if name in ("utf-8", "utf8", "utf-8-sig", "utf-8-bom") else name

    def csv_options(self) -> dict[str, Any]:
        """For Python's reader and writer."""
        import csv

        return {
            "delimiter": self.delimiter,
            "doublequote": self.double_quote,
            "escapechar": None if self.double_quote else "\\",
            "quotechar": self.quote_char or '"',
            "quoting": csv.QUOTE_MINIMAL if self.quote_char else csv.QUOTE_NONE,
            "skipinitialspace": self.skip_initial_space,
            "strict": True,
        }

    def spark_options(self) -> dict[str, str]:
        """For Spark's reader, where :meth:`plain` holds."""
        quote = self.quote_char or "\u0000"
        return {"sep": self.delimiter, "quote": quote, "escape": quote if self.double_quote else "\\", "encoding": self.encoding, "emptyValue": "", "nullValue": "\u0000", "multiLine": "true", "header": "false", "ignoreLeadingWhiteSpace": str(self.skip_initial_space).lower()}

    @property
    def plain(self) -> bool:
        """Can Spark's own reader stand in?  It drops blank lines and knows no line numbers."""
        return self.comment_prefix is None and self.skip_blank_rows and self.trim == "false" and not self.skip_columns and not self.skip_rows and self.python_encoding == "utf-8-sig"

    def trimmed(self, cell: str) -> str:
        return {"true": cell.strip, "start": cell.lstrip, "end": cell.rstrip}.get(self.trim, lambda: cell)()

    def asdict(self, full: bool = False) -> dict[str, Any]:
        out = {}
        for key, name in PROPERTIES.items():
            value = getattr(self, name)
            if full or value != getattr(Dialect(comment_prefix=None), name):
                out[key] = list(value) if isinstance(value, tuple) else value
        return out


def normal_name(text: str, position: int | None = None) -> str:
    """A header as an identifier: letters, digits and underscores, not beginning with a digit."""
    made = re.sub(r"\W+", "_", text.strip()).strip("_") or (f"_{position}" if position is not None else "_")
    return f"_{made}" if made[0].isdigit() else made


def slug(text: str, lowercase: bool = True) -> str:
    """Letters and digits of a text without marks."""
    import unicodedata

    bare = "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn")
    made = re.sub(r"[^A-Za-z0-9]", "", bare)
    return made.lower() if lowercase else made
