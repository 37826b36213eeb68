"""Text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words of the C locale: non-breaking and ideographic spaces do not part them.
WORD = r"[^ \t\n\x0B\f\r]+"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def words(text: Column | str) -> Column:
    return F.regexp_extract_all(_col(text), F.lit(WORD), F.lit(0))


def first_line(text: Column | str) -> Column:
    return F.substring_index(_col(text), "\n", 1)


def without_newlines(text: Column | str) -> Column:
    return F.translate(_col(text), "\n", "")


def without_return(line: Column | str) -> Column:
    """The line without one carriage return at its end."""
    return F.regexp_replace(_col(line), r"\r\z", "")


def hex_dump(text: Column | str, most: int = 1023) -> Column:
    """Upper-case hexadecimal digits of the first ``most`` UTF-8 bytes."""
    return F.hex(F.substring(F.encode(_col(text), "UTF-8"), 1, most))


def entry_path(directory: str, id_: Column | str) -> Column:
    return F.concat(F.lit(directory.rstrip("/") + "/"), _col(id_).cast("string"), F.lit(".txt"))
