"""Number formats: a pattern becomes one regular expression, a value one expression."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

PATTERN_CHARS = set("#0.,;%‰E-+")


@dataclass(frozen=True)
class NumberFormat:
    """``pattern`` is written with ``,`` and ``.`` whatever the characters of the data are."""

    pattern: str | None = None
    group_char: str | None = None
    decimal_char: str | None = None
    #: Numbers are kept as their digits, however many, instead of as a decimal of 38.
    exact: bool = False
    #: May other characters (a currency, a unit) not stand around a number?  They are left out otherwise.
    bare: bool = True

    @property
    def group(self) -> str:
        return self.group_char or ","

    @property
    def point(self) -> str:
        return self.decimal_char or "."

    # What the positive half of the pattern demands.
    def _halves(self) -> tuple[str, str, str]:
        body = self.pattern.split(";")[0]
        mantissa, _, exponent = body.partition("E")
        whole, _, decimals = mantissa.partition(".")
        return whole, decimals, exponent

    def grouping(self) -> tuple[int, int] | None:
        parts = [sum(c in "#0" for c in p) for p in self._halves()[0].split(",")]
        if len(parts) == 1:
            return None
        return parts[-1], parts[1] if len(parts) > 2 else parts[-1]

    def digits(self) -> tuple[int, int, int, int]:
        """Least whole digits, least and most decimals, most exponent digits."""
        whole, decimals, exponent = self._halves()
        return len(re.search("0*$", whole)[0]), len(re.match("0*", decimals)[0]), sum(c in "#0" for c in decimals), sum(c in "#0" for c in exponent)

    @property
    def scale(self) -> int:
        """Digits behind the point of the values: as many as the pattern allows, else 18."""
        if not self.pattern or self._halves()[2]:
            return 18
        shift = 2 if "%" in self.pattern else 3 if "‰" in self.pattern else 0
        return min(18, self.digits()[2] + shift)

    def regex(self) -> str:
        """Matches a text whose group and decimal characters are ``,`` and ``.`` already."""
        least, low, high, exponent = self.digits()
        if size := self.grouping():
            first, more = size
            whole = rf"(?:\d{{0,{more}}}(?:,\d{{{more}}})*,\d{{{first}}}|\d{{0,{first}}})"
        else:
            whole = r"\d*(?:,\d+)*"
        enough = {0: "", 1: r"(?=[+\-%‰]?,?\d)"}.get(least, rf"(?=[+\-%‰]?[0,]*[1-9](?:,?\d){{{least - 1},}})")
        fraction = rf"\.\d{{{low},{high}}}" if low else rf"(?:\.\d{{0,{high}}})?"
        power = rf"(?:[eE][+\-]?\d{{1,{exponent}}})?" if exponent else ""
        return rf"^{enough}[+\-%‰]?{whole}{fraction}{power}[%‰]?\z"


def plain_number(text: Column, f: NumberFormat) -> Column:
    """The text with ``,`` for groups and ``.`` for the point, without what stands around the number."""
    if not f.bare:
        text = F.regexp_replace(text, r"^[^0-9+\-]+|[^0-9]+\z", "")
    if f.group == "," and f.point == ".":
        return text
    return F.translate(text, f.group + f.point, ",.")


def once(value: Column, build: Callable[[Column], Column]) -> Column:
    """What ``build`` makes of a value that it reads more than once: worked out once, as a function's variable.

    Such a function stays out of the generated code, whose methods are compiled only while they are
    short; so it also serves for what few cells need."""
    return F.get(F.transform(F.array(value), build), F.lit(0))


def parse_decimal(text: Column, f: NumberFormat, scale: int = 18) -> Column:
    """decimal(38, scale), null if malformed: exponents and doubled group characters are, and
    so is a number with more digits than the type holds.

    Digits with a point or without are read at once, all else (percent, groups without a pattern,
    many zeros) the long way."""
    plain, kind = plain_number(text, f), f"decimal(38,{scale})"
    bare = F.translate(plain, ",", "") if f.pattern and f.grouping() else plain
    common = rf"^[+-]?\d{{1,{38 - scale}}}" + (rf"(?:\.\d{{1,{scale}}})?\z" if scale else r"\z")
    value = F.when(bare.rlike(common), bare.try_cast(kind)).otherwise(once(plain, lambda x: _any_decimal(x, scale)))
    return F.when(plain.rlike(f.regex()), value) if f.pattern else value


def _any_decimal(plain: Column, scale: int) -> Column:
    ok = plain.rlike(r"^(?!.*,,)(?=.*\d)[+\-%‰]?[\d,]*\.?\d*[%‰]?\z")
    bare = F.translate(plain, ",%‰", "")

    def held(behind: int) -> Column:
        fits = bare.rlike(rf"^[+-]?0*\d{{0,{38 - scale}}}(?:\.\d{{0,{max(0, behind)}}}0*)?\z")
        return F.when(fits, bare.try_cast(f"decimal(38,{scale})"))

    # A shifted number is read with its point where it will stand.
    moved = lambda k: F.regexp_replace(F.regexp_replace(bare, r"^([+-]?)(\d*)\.?(\d*)\z", "$1" + "0" * k + "$2.$3"), rf"(\d{{{k}}})\.", ".$1").try_cast(f"decimal(38,{scale})")
    few = lambda k: bare.rlike(rf"^[+-]?0*\d{{0,{38 - scale}}}(?:\.\d{{0,{max(0, scale - k)}}}0*)?\z")
    shifted = F.when(plain.contains("%"), F.when(few(2), moved(2))).when(plain.contains("‰"), F.when(few(3), moved(3))).otherwise(held(scale))
    return F.when(ok, shifted)


def format_decimal(value: Column, f: NumberFormat) -> Column:
    """Digits without trailing zeros, or as the pattern demands."""
    text = value.cast("string")
    text = F.when(text.contains("."), F.regexp_replace(F.regexp_replace(text, "0+$", ""), r"\.$", "")).otherwise(text)
    percent = ""
    if f.pattern:
        least, low, high, _ = f.digits()
        percent = next((c for c in "%‰" if c in f.pattern), "")
        factor = {"%": 100, "‰": 1000}.get(percent, 1)
        rounded = F.round(value * F.lit(factor) if factor > 1 else value, high).cast(f"decimal(38,{high})")
        sign = F.when(rounded < 0, "-").otherwise("")
        digits = F.abs(rounded).cast("string")
        whole = F.lpad(F.regexp_replace(F.substring_index(digits, ".", 1), "^0+(?=.)", ""), 40, " ")
        whole = F.regexp_replace(whole, "^ +", "")
        whole = F.when(F.length(whole) < least, F.lpad(whole, least, "0")).otherwise(whole)
        if size := f.grouping():
            first, more = size
            whole = F.regexp_replace(whole, rf"(?<=\d)(?=(?:\d{{{more}}})*\d{{{first}}}$)", ",")
        decimals = F.regexp_replace(F.substring(F.substring_index(digits, ".", -1), 1, max(high, 1)), "0+$", "") if high else F.lit("")
        decimals = F.when(F.length(decimals) < low, F.rpad(decimals, low, "0")).otherwise(decimals)
        text = F.concat(sign, whole, F.when(decimals == "", "").otherwise(F.concat(F.lit("."), decimals)))
    if f.group != "," or f.point != ".":
        text = F.translate(text, ",.", f.group + f.point)
    return F.concat(text, F.lit(percent))


# Numbers of any size, as text: a sign if negative, digits without needless zeros.


def parse_exact(text: Column, f: NumberFormat) -> Column:
    """The digits of a number of any size, null if malformed; percent and per mille shift the point."""
    moved = lambda bare, k: F.regexp_replace(F.regexp_replace(bare, r"^([+-]?)(\d*)\.?(\d*)\z", "$1" + "0" * k + "$2.$3"), rf"(\d{{{k}}})\.", ".$1")

    def shifted(plain: Column) -> Column:
        bare = F.translate(plain, ",%‰", "")
        ok = plain.rlike(r"^(?!.*,,)(?=.*\d)[+\-%‰]?[\d,]*\.?\d*[%‰]?\z")
        ok = ok & plain.rlike(f.regex()) if f.pattern else ok
        return F.when(ok, F.when(plain.contains("%"), moved(bare, 2)).when(plain.contains("‰"), moved(bare, 3)).otherwise(bare))

    def canonical(bare: Column) -> Column:
        digits = F.when(bare.contains("."), F.regexp_replace(F.regexp_replace(bare, r"0+\z", ""), r"\.\z", "")).otherwise(bare)
        digits = F.regexp_replace(F.regexp_replace(digits, r"^[+-]?0*", ""), r"^(?=\.|\z)", "0")
        return once(digits, lambda d: F.when(bare.startswith("-") & (d != "0"), F.concat(F.lit("-"), d)).otherwise(d))

    return once(once(plain_number(text, f), shifted), canonical)


def order_exact(number: Column) -> Column:
    """A text that is smaller than another if the number is: the sign, how many whole digits there are,
    the digits; of negative numbers the digits' complement, and what ends first is larger."""

    def key(n: Column) -> Column:
        digits = F.ltrim(n, F.lit("-"))
        sized = F.concat(F.lpad(F.length(F.substring_index(digits, ".", 1)).cast("string"), 10, "0"), digits)
        return F.when(n.startswith("-"), F.concat(F.lit("0"), F.translate(sized, "0123456789", "9876543210"), F.lit("~"))).otherwise(F.concat(F.lit("1"), sized))

    return once(number, key)


def format_exact(number: Column, f: NumberFormat) -> Column:
    """The digits as the pattern demands; a pattern never takes digits away from a number that fits it."""
    text, percent = number, ""
    if f.pattern:
        least, low, _, _ = f.digits()
        percent = next((c for c in "%‰" if c in f.pattern), "")
        if k := {"%": 2, "‰": 3}.get(percent, 0):
            padded = F.concat(F.regexp_replace(text, r"^(-?\d+)\z", "$1."), F.lit("0" * k))
            text = F.regexp_replace(F.regexp_replace(padded, rf"\.(\d{{{k}}})", "$1."), r"^(-?)0+(?=\d)", "$1")
            text = F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+\z", "$1"), r"\.\z", "")

        def whole_digits(t: Column) -> Column:
            whole = F.substring_index(F.ltrim(t, F.lit("-")), ".", 1)
            whole = F.regexp_replace(whole, r"^0\z", "") if not least else F.lpad(whole, F.greatest(F.length(whole), F.lit(least)), F.lit("0"))
            whole = F.when((whole == "") & ~t.contains("."), "0").otherwise(whole) if not least else whole
            if size := f.grouping():
                first, more = size
                whole = F.regexp_replace(whole, rf"(?<=\d)(?=(?:\d{{{more}}})*\d{{{first}}}$)", ",")
            return whole

        def shown(t: Column) -> Column:
            decimals = F.when(t.contains("."), F.substring_index(t, ".", -1)).otherwise("")
            decimals = F.rpad(decimals, F.greatest(F.length(decimals), F.lit(low)), F.lit("0")) if low else decimals
            behind = once(decimals, lambda d: F.when(d == "", "").otherwise(F.concat(F.lit("."), d)))
            return F.concat(F.when(t.startswith("-"), "-").otherwise(""), whole_digits(t), behind)

        text = once(text, shown)
    if f.group != "," or f.point != ".":
        text = F.translate(text, ",.", f.group + f.point)
    return F.concat(text, F.lit(percent))
