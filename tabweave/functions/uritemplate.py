"""URI templates (RFC 6570, levels 1 to 3) as Python strings or Spark expressions."""

from __future__ import annotations

import re
from collections.abc import Mapping
from urllib.parse import quote

from pyspark.sql import Column
from pyspark.sql import functions as F

_EXPRESSION = re.compile(r"\{([+#./;?&]?)([^{}]*)\}")
#: Operator: first character, separator, named, what stays unescaped; fixed values.
_KINDS = {
    "": ("", ",", False, ""),
    "+": ("", ",", False, ":/?#[]@!$&'()*+,;="),
    "#": ("#", ",", False, ":/?#[]@!$&'()*+,;="),
    ".": (".", ".", False, ""),
    "/": ("/", "/", False, ""),
    ";": (";", ";", True, ""),
    "?": ("?", "&", True, ""),
    "&": ("&", "&", True, ""),
}


def variables(template: str) -> list[str]:
    return [v.strip() for m in _EXPRESSION.finditer(template) for v in m[2].split(",") if v.strip()]


def expand(template: str, values: Mapping[str, object]) -> str:
    """Undefined variables (missing or None) are left out."""

    def one(m: re.Match) -> str:
        first, separator, named, safe = _KINDS[m[1]]
        made = []
        for name in (v.strip() for v in m[2].split(",")):
            if values.get(name) is None:
                continue
            text = quote(str(values[name]), safe=safe + "-._~")
            made.append(f"{name}={text}" if named and (text or m[1] != ";") else name if named else text)
        return first + separator.join(made) if made else ""

    return _EXPRESSION.sub(one, template)


def _escaped(value: Column, safe: str) -> Column:
    text = F.replace(F.replace(F.url_encode(value), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A"))
    text = F.replace(text, F.lit("%7E"), F.lit("~"))
    for c in safe:
        text = F.replace(text, F.lit(quote(c, safe="")), F.lit(c))
    return text


def compile_template(template: str, values: Mapping[str, Column]) -> Column:
    """The same expansion as one expression over string columns."""
    parts: list[Column] = []
    at = 0
    for m in _EXPRESSION.finditer(template):
        parts.append(F.lit(template[at : m.start()]))
        at = m.end()
        first, separator, named, safe = _KINDS[m[1]]
        made = []
        for name in (v.strip() for v in m[2].split(",")):
            if name in values:
                text = _escaped(values[name].cast("string"), safe)
                if named:
                    bare = F.lit(name) if m[1] == ";" else F.lit(f"{name}=")
                    text = F.when(text == "", bare).otherwise(F.concat(F.lit(f"{name}="), text))
                made.append(text)
        if made:
            joined = F.concat_ws(separator, *made)
            some = F.coalesce(*[F.when(x.isNotNull(), F.lit(True)) for x in made], F.lit(False))
            parts.append(F.when(some, F.concat(F.lit(first), joined)).otherwise(F.lit("")))
    parts.append(F.lit(template[at:]))
    return F.concat(*parts)
