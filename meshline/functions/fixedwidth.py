"""Fields of fixed-width lines as Columns. Lines are bytes held as ISO-8859-1 text, so a character is a byte."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Header fields of an element record: name -> (offset, width). Fixed values of the file format.
ELEMENT_FIELDS: dict[str, tuple[int, int]] = {
    "dmcode": (2, 4), "dmregion": (6, 2), "dminfo": (8, 4), "dmelemid": (12, 4), "dmfigtype": (18, 2), "following": (20, 1), "dmprec": (21, 2),
    "annotation_type": (23, 1), "dmmove": (24, 2), "dmskip": (26, 1), "data_count": (27, 4), "record_count": (31, 4), "dmattr": (49, 7),
    "dmattrkind": (56, 2), "dmyymm": (65, 4), "dmupyymm": (69, 4), "dmdelyymm": (73, 4),
}
#: The twelve code columns that features carry.
CODE_FIELDS = ("dmfigtype", "dmmove", "dmskip", "dmattr", "dmprec", "dmyymm", "dmregion", "dminfo", "dmelemid", "dmattrkind", "dmupyymm", "dmdelyymm")


def fw_slice(line: Column, offset: int | Column, width: int) -> Column:
    """``width`` bytes from ``offset``; null where the line ends before."""
    start = F.lit(offset) if isinstance(offset, int) else offset
    return F.when(F.length(line) >= start + width, F.substr(line, start + 1, F.lit(width)))


def fw_int(line: Column, offset: int | Column, width: int) -> Column:
    """A trimmed whole number, null if it is none."""
    text = F.trim(fw_slice(line, offset, width))
    return F.when(text.rlike(r"^[+-]?[0-9]+$"), text.try_cast("long"))


def fw_double(line: Column, offset: int | Column, width: int) -> Column:
    """A trimmed decimal number, null if it is none."""
    text = F.trim(fw_slice(line, offset, width))
    return F.when(text.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), text.try_cast("double"))


def header_fields(header: Column) -> dict[str, Column]:
    """All whole-number fields of an element header."""
    return {name: fw_int(header, *place) for name, place in ELEMENT_FIELDS.items()}


def first_error(checks: list[tuple[Column, str | Column]]) -> Column:
    """The message of the first check that holds, else null."""
    return F.coalesce(*(F.when(bad, F.lit(message) if isinstance(message, str) else message) for bad, message in checks))


def zone_or_null(zone: Column) -> Column:
    return F.when(zone.between(1, 19), zone.cast("int"))
