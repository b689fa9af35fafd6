"""Column helpers with the Unicode rules that the workloads rely on. All stay JVM-side."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

BASE36_DIGITS = "0123456789abcdefghijklmnopqrstuvwxyz"
LONG_WORD = r"(?U)\b\w{15,}\b"


def tokens(text: Column) -> Column:
    """Tokens between runs of Unicode white space; blank text gives an empty array, null stays null."""
    return F.array_remove(F.split(text, r"(?U)\s+"), "")


def trimmed(text: Column) -> Column:
    """Text without Unicode white space at its ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def plain_number(value: Column) -> Column:
    """A double as text without exponent, and without a fraction of zero: 3, 0.5, 12345678."""
    text = value.cast("string")
    whole = F.regexp_replace(text, r"\.0$", "")
    mantissa, power = F.regexp_extract(text, r"^-?([0-9.]+)E", 1), F.regexp_extract(text, r"E(-?\d+)$", 1)
    digits = F.regexp_replace(F.replace(mantissa, F.lit(".")), "0+$", "")
    shift = F.when(power == "", F.lit("0")).otherwise(power).cast("int")
    # the point stands after the first digit; it moves by the power of ten
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -shift - 1), digits)
    large = F.when(F.length(digits) <= shift + 1, F.rpad(digits, shift + 1, "0")).otherwise(F.concat(F.substring(digits, F.lit(1), shift + 1), F.lit("."), F.substring(digits, shift + 2, F.length(digits))))
    sign = F.when(text.startswith("-"), F.lit("-")).otherwise(F.lit(""))
    return F.when(~text.contains("E"), whole).when(shift < 0, F.concat(sign, small)).otherwise(F.concat(sign, large))


def quoted_line(quoted: list[Column], plain: list[Column]) -> Column:
    """Comma-separated text: first the fields in double quotes, then those without."""
    return F.concat_ws(",", *(F.concat(F.lit('"'), q, F.lit('"')) for q in quoted), *plain)


def title_year(title: Column) -> Column:
    """The four characters before the last one of a title like ``Name (1999)`` as a number; others fail the task."""
    return F.substring(title, -5, 4).cast("int")


def strip_cr(line: Column) -> Column:
    """A line without one trailing carriage return."""
    return F.regexp_replace(line, r"\r$", "")


def has_long_word(line: Column) -> Column:
    """Whether a line holds a run of 15 or more word characters."""
    return line.rlike(LONG_WORD)


def longest_alpha_bytes(line: Column) -> Column:
    """UTF-8 length of the longest run of letters; 0 when there is none."""
    runs = F.regexp_extract_all(line, F.lit(r"([\p{IsAlphabetic}]+)"), F.lit(1))
    return F.coalesce(F.array_max(F.transform(runs, F.octet_length)), F.lit(0))


def number_table(numbers: Iterable[int]) -> Column:
    """A constant array."""
    return F.expr(f"array({', '.join(map(str, numbers))})")


def base36_digit(text: Column, place: int) -> Column:
    """Digit of the character at ``place`` (from 1): missing is 0, other characters are 37."""
    c = F.substring(text, place, 1)
    digits = [BASE36_DIGITS.find(chr(i).lower()) for i in range(128)]
    digit = F.get(number_table(37 if d < 0 else d for d in digits), F.ascii(c))
    return F.when(c == "", 0).otherwise(F.coalesce(digit, F.lit(37)))


def scaled(digit: int, low: int, high: int) -> int:
    """Integer position of a digit 0..36 in low..high; 37 is the upper end."""
    return high if digit >= 37 else low + digit * (high - low) // 37


def alpha_bucket(word: Column, buckets: int = 200) -> Column:
    """Alphabetic range id in 0..buckets from the first two characters of a word."""
    ends = [scaled(first, 0, buckets) for first in range(39)]
    table = number_table(scaled(second, ends[first], ends[first + 1]) for first in range(38) for second in range(38))
    return F.get(table, base36_digit(word, 1) * 38 + base36_digit(word, 2))


def first_letter_half(word: Column) -> Column:
    """0 for words up to m or M, 1 beyond; the case test is Unicode-aware."""
    c = F.substring(word, 1, 1)
    limit = F.when(c.rlike(r"^\p{Ll}"), F.ascii(F.lit("m"))).otherwise(F.ascii(F.lit("M")))
    return F.when(F.ascii(c) > limit, 1).otherwise(0)


def quoted_fields(line: Column) -> Column:
    """Comma-separated fields; double quotes group, and are dropped. There is no escape."""
    parts = F.split(line, r',(?=(?:[^"]*"[^"]*")*[^"]*$)')
    return F.transform(parts, lambda p: F.replace(p, F.lit('"'), F.lit("")))


def strict_utf8(data: Column) -> Column:
    """Text of a binary column; invalid UTF-8 fails the task."""
    return F.validate_utf8(data.cast("string"))
