"""Date and time formats of the tabular metadata recommendation."""

from __future__ import annotations

import re
from dataclasses import dataclass

# Formats of dates and of times that the recommendation names; fixed values.
DATE_FORMATS = (
    "yyyy-MM-dd yyyyMMdd dd-MM-yyyy d-M-yyyy MM-dd-yyyy M-d-yyyy dd/MM/yyyy d/M/yyyy "
    "MM/dd/yyyy M/d/yyyy dd.MM.yyyy d.M.yyyy MM.dd.yyyy M.d.yyyy"
).split()
TIME_FORMATS = "HH:mm:ss HHmmss HH:mm HHmm".split()

_LEXICAL = {"yyyy": r"\d{4}", "MM": r"\d{2}", "dd": r"\d{2}", "M": r"\d{1,2}", "d": r"\d{1,2}", "HH": r"\d{2}", "mm": r"\d{2}", "ss": r"\d{2}"}
_FIELD = re.compile("yyyy|MM|dd|M|d|HH|mm|ss")
#: Zone markers and what they match.
_ZONES = {"X": r"(?:Z|[+-]\d{2}(?:\d{2})?)", "XX": r"(?:Z|[+-]\d{4})", "XXX": r"(?:Z|[+-]\d{2}:\d{2})"}


@dataclass(frozen=True)
class DateFormat:
    """A validated format: its regular expression and Spark's pattern, without the zone."""

    date: str | None
    separator: str
    time: str | None
    fraction: int
    zone: str

    @property
    def spark(self) -> str:
        middle = "'T'" if self.separator == "T" else self.separator
        return (self.date or "") + middle + (self.time or "") + (f"[.{'S' * self.fraction}]" if self.fraction else "")

    @property
    def castable(self) -> bool:
        """Is a text of this form one that a cast reads, which costs less than a pattern?"""
        return self.date == "yyyy-MM-dd" and self.time in (None, "HH:mm:ss") and self.fraction <= 6

    @property
    def lexical(self) -> str:
        body = _FIELD.sub(lambda m: _LEXICAL[m[0]], re.escape(self.date or "").replace(r"\-", "-"))
        clock = _FIELD.sub(lambda m: _LEXICAL[m[0]], self.time or "")
        return body + self.separator + clock + (rf"(?:\.\d{{1,{self.fraction}}})?" if self.fraction else "")

    @property
    def zone_regex(self) -> str:
        """Of the zone at the end of a text; optional unless the format names one."""
        if not self.zone:
            return r"(?:Z|[+-]\d{2}:\d{2})?"
        space, marker = self.zone[: -len(self.zone.strip())] if self.zone.strip() != self.zone else "", self.zone.strip().upper()
        return re.escape(space) + _ZONES[marker]


def parse_format(text: str, time_only: bool = False) -> DateFormat:
    """Split a format, or raise ValueError."""
    marker = re.search(" ?(x{1,3}|X{1,3})$", text)
    zone, body = (marker[0], text[: marker.start()]) if marker else ("", text)
    if re.search("[xX]$", body):
        raise ValueError(f"zone markers may not be mixed: {text}")
    separator = next((s for s in " T" if s in body), "")
    if separator:
        date, _, time = body.partition(separator)
    else:
        date, time = (None, body) if time_only else (body, None)
    fraction = 0
    if time and "." in time:
        time, _, marks = time.partition(".")
        if set(marks) != {"S"}:
            raise ValueError(f"not a format of fractions: {text}")
        fraction = len(marks)
    if (date and date not in DATE_FORMATS) or (time and time not in TIME_FORMATS) or (separator and not (date and time)):
        raise ValueError(f"not a format of dates or times: {text}")
    return DateFormat(date, separator, time, fraction, zone)
