"""Names as identifiers, as columns; the forms for headers are in :mod:`..sources.dialect`."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F


@cache
def _marked_letters() -> tuple[str, str]:
    """Latin letters with marks, and the letters without."""
    marked, bare = [], []
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        base = unicodedata.normalize("NFD", chr(code))[0]
        if base.isascii():
            marked.append(chr(code))
            bare.append(base)
    return "".join(marked), "".join(bare)


def slug_column(text: Column, lowercase: bool = True) -> Column:
    """Letters and digits of a text without marks."""
    made = F.regexp_replace(F.translate(text, *_marked_letters()), "[^A-Za-z0-9]", "")
    return F.lower(made) if lowercase else made


def name_column(text: Column) -> Column:
    """A text as an identifier: letters, digits and underscores, not beginning with a digit."""
    made = F.regexp_replace(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""), r"(?U)\W+", "_")
    made = F.regexp_replace(made, "^_+|_+$", "")
    return F.when(made == "", "_").when(made.rlike(r"(?U)^\d"), F.concat(F.lit("_"), made)).otherwise(made)
