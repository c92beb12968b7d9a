"""String expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def characters(text: Column | str) -> Column:
    """The characters of a string, in order, as an array; none for the empty string."""
    col = F.col(text) if isinstance(text, str) else text
    return F.array_remove(F.split(col, ""), "")


def suffix(path: Column | str) -> Column:
    """File extension with its dot, lower-cased; empty if the name has none.

    A name that starts with its only dot (``.pdf``) has no extension, as with pathlib.
    """
    col = F.col(path) if isinstance(path, str) else path
    return F.lower(F.regexp_extract(col, r"[^/\\](\.[^./\\]+)$", 1))


def base_name(path: Column | str) -> Column:
    col = F.col(path) if isinstance(path, str) else path
    return F.regexp_extract(col, r"([^/\\]+)$", 1)


def stem(path: Column | str) -> Column:
    """File name without folder and last extension."""
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]+$", "")


def message_with_details(message: Column, details: Column) -> Column:
    """``message (k=v, k2=v2)``, or only the message when there are no details."""
    pairs = F.transform(F.map_entries(details), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    shown = F.concat(message, F.lit(" ("), F.array_join(pairs, ", "), F.lit(")"))
    return F.when(F.coalesce(F.size(details), F.lit(0)) > 0, shown).otherwise(message)


def fixed(value: Column, digits: int) -> Column:
    """Number as text with ``digits`` decimals, ties to the even digit."""
    scale = 10 ** digits
    return F.format_string(f"%.{digits}f", F.rint(value * scale) / scale)
