"""Text column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Blanks (of ASCII and Unicode) removed at both ends, and texts that mean "missing".
BLANKS = (" \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
          "\u2028\u2029\u202f\u205f\u3000")
MISSING_TOKENS = ("nan", "None", "")

# A boundary before each cased letter that follows anything but a cased letter.
_CASED = r"\p{IsUppercase}\p{IsLowercase}\p{Lt}"
_WORD_START = rf"(?<=[^{_CASED}])(?=[{_CASED}])"


def strip(text: Column) -> Column:
    return F.btrim(text.cast("string"), F.lit(BLANKS))


def clean_text(text: Column) -> Column:
    """Stripped text, null where nothing or a missing-value token is left."""
    stripped = strip(text)
    return F.when(~stripped.isin(*MISSING_TOKENS), stripped)


def title_case(text: Column) -> Column:
    """Upper-case every letter that follows a non-letter, lower-case the rest.

    ``initcap`` alone only looks at blanks: it would leave ``cad/cam`` as
    ``Cad/cam`` where this gives ``Cad/Cam``.
    """
    pieces = F.split(F.lower(text), _WORD_START)
    return F.array_join(F.transform(pieces, F.initcap), "")


def derive_key(text: Column, width: int = 10) -> Column:
    """Short upper-case key from the ASCII letters and digits of ``text``."""
    return F.upper(F.substring(F.regexp_replace(text, "[^a-zA-Z0-9]", ""), 1, width))


def short_label(text: Column, width: int = 10) -> Column:
    """Short upper-case label that keeps every character (used in reports)."""
    return F.substring(F.upper(text), 1, width)


def display_name(text: Column) -> Column:
    """A column name as a heading: underscores to blanks, title case."""
    return title_case(F.replace(text, F.lit("_"), F.lit(" ")))


def contains_ignore_case(text: Column, needle: str) -> Column:
    return F.lower(text.cast("string")).contains(needle.lower())


def one_decimal(value: Column) -> Column:
    """Number as text with one decimal, rounded by its exact binary value.

    The built-in formatter rounds the shortest decimal form half up, which
    shows 64.25 as 64.3. Here 10x is split into an exact sum (8x + 2x), so ties
    are seen as they are and go to the even digit.
    """
    eight, two = value * 8.0, value * 2.0
    tenths = eight + two
    lost = two - (tenths - eight)
    base = F.floor(tenths).cast("double")
    over = tenths - base
    up = (over > 0.5) | ((over == 0.5) & ((lost > 0) | ((lost == 0) & (base % 2 != 0))))
    return F.format_string("%.1f", (base + up.cast("int")) / 10.0)
