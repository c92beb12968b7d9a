"""Character sets and label expressions for sequence decoding."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from pagewright.functions.text import characters

#: The recogniser's character sets.
DIGITS = "0123456789"
ALPHANUMERIC = "0123456789abcdefghijklmnopqrstuvwxyz"
ENGLISH = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
EXTENDED = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ!@#$%^&*()-_=+[]{}|;:,.<>?/~` "
CHARSETS = {
    "english": ENGLISH,
    "alphanumeric": ALPHANUMERIC,
    "digits": DIGITS,
    "extended": EXTENDED,
}
#: Fixed value: the blank symbol, index 0.
BLANK = "-"


def char_index(ch: Column, charset: str = ALPHANUMERIC) -> Column:
    """Label of a character: 1-based place in the set, 0 for the blank symbol, -1 if absent.

    Where the set itself holds the blank symbol its place in the set wins.
    """
    if BLANK not in charset:
        return F.instr(F.lit(BLANK + charset), ch) - 1
    place = F.instr(F.lit(charset), ch)
    return F.when(place > 0, place).otherwise(-1)


def index_char(idx: Column, charset: str = ALPHANUMERIC) -> Column:
    """The character of a label; the blank symbol for 0."""
    return F.substring(F.lit(BLANK + charset), idx + 1, F.lit(1))


def ctc_encode(text: Column | str, charset: str = ALPHANUMERIC) -> Column:
    """Labels of a text as an array: lower-cased characters, unknown ones left out."""
    col = F.col(text) if isinstance(text, str) else text
    # Lower-cased alone, the dotted capital I is two characters and so in no set.
    lowered = F.lower(F.replace(col, F.lit("\u0130"), F.lit("")))
    unknown = "[^" + "".join(c if c.isalnum() else "\\" + c for c in BLANK + charset) + "]"
    # Every character that is left has a label.
    return F.transform(characters(F.regexp_replace(lowered, unknown, "")), lambda c: char_index(c, charset))
