"""Cells of exports and labels of the grid, as native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMBER = r"^[+-]?(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|(?i:inf|infinity|nan))$"


def cell_norm(text: Column) -> Column:
    """Runs of white space as one space, trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def cell_defuse(text: Column) -> Column:
    """An apostrophe before what a spreadsheet would take for a formula; numbers stay."""
    return F.when(text.rlike(r"^[=+\-@\t\r]") & ~text.rlike(_NUMBER), F.concat(F.lit("'"), text)).otherwise(text)


def cell(value: Column, kind: str = "string") -> Column:
    """A value as export text: null as "", booleans as true and false, strings normalized and defused."""
    text = cell_defuse(cell_norm(value)) if kind == "string" else value.cast("string")
    return F.coalesce(text, F.lit(""))


def format_bytes(n: Column) -> Column:
    kb, mb, gb = 1024, 1024**2, 1024**3
    return (
        F.when(F.coalesce(n, F.lit(0)) == 0, "0 B").when(n < kb, F.concat(n.cast("string"), F.lit(" B"))).when(n < mb, F.format_string("%.1f KB", n / kb))
        .when(n < gb, F.format_string("%.1f MB", n / mb)).otherwise(F.format_string("%.2f GB", n / gb))
    )


def length_quality(text: Column, least: int, most: int) -> Column:
    n = F.length(F.coalesce(text, F.lit("")))
    return F.when(n == 0, "").when(n > most, "over").when(n < least, "under").otherwise("ok")


def cls_quality(cls: Column) -> Column:
    return F.when(F.coalesce(cls, F.lit(0.0)) == 0, "").when(cls > 0.25, "poor").when(cls > 0.1, "needs work").otherwise("ok")


def heading_count_flag(n: Column) -> Column:
    return F.when(n == 0, "Missing").when(n > 1, "Multiple").otherwise("")


def js_round(x: Column) -> Column:
    """Half up, as a long."""
    return F.floor(x + 0.5).cast("long")


def standardize_date(raw: Column) -> tuple[Column, Column]:
    """dd-MM-yyyy and HH:mm:ss UTC of a date in one of the usual notations, or "" and ""."""
    text = F.trim(F.coalesce(raw, F.lit("")))
    ts = F.coalesce(
        F.try_to_timestamp(F.regexp_replace(text, r"^(\d{4}-\d{2}-\d{2})$", "$1T00:00:00Z")), F.try_to_timestamp(F.regexp_replace(text, "^[A-Za-z]{3}, *", ""), F.lit("d MMM yyyy HH:mm:ss z")),
        F.try_to_timestamp(text, F.lit("d MMMM yyyy")), F.try_to_timestamp(text, F.lit("MMMM d, yyyy")), F.try_to_timestamp(text, F.lit("yyyy/MM/dd")),
    )
    return F.coalesce(F.date_format(ts, "dd-MM-yyyy"), F.lit("")), F.coalesce(F.concat(F.date_format(ts, "HH:mm:ss"), F.lit(" UTC")), F.lit(""))


# The white space between words of a page's text, and the offset and prime of 32-bit FNV-1a.
_BLANK = r"\x20\x09-\x0D\xA0"
_FNV_OFFSET, _FNV_PRIME = 2166136261, 16777619


def word_count(body: Column) -> Column:
    """Runs of what is no white space."""
    return F.regexp_count(F.coalesce(body, F.lit("")), F.lit(f"[^{_BLANK}]+")).cast("long")


def content_hash(body: Column) -> Column:
    """FNV-1a over the UTF-16 units of a text, in hex; a run of white space counts as one space, none at the start. Empty
    for a text without words. A fold over its characters: one beyond 16 bits is two units."""
    folded = F.regexp_replace(F.regexp_replace(F.coalesce(body, F.lit("")), f"^[{_BLANK}]+", ""), f"[{_BLANK}]+", " ")
    mixed = lambda h, unit: (h.bitwiseXOR(unit) * F.lit(_FNV_PRIME)).bitwiseAND(F.lit(0xFFFFFFFF))

    def step(h: Column, c: Column) -> Column:
        code = F.ascii(c).cast("long")
        high, low = F.shiftright(code - 0x10000, 10) + 0xD800, (code - 0x10000).bitwiseAND(F.lit(0x3FF)) + 0xDC00
        return F.when(code < 0x10000, mixed(h, code)).otherwise(mixed(mixed(h, high), low))

    h = F.aggregate(F.regexp_extract_all(folded, F.lit("(?s)."), F.lit(0)), F.lit(_FNV_OFFSET).cast("long"), step)
    return F.when(word_count(body) > 0, F.lower(F.hex(h))).otherwise("")
