"""Small column functions: display names, CSV cells."""

from __future__ import annotations

import codecs

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def csv_guard(cell: Column) -> Column:
    """A cell that a spreadsheet would read as a formula gets an apostrophe."""
    return F.when(cell.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), cell)).otherwise(cell)


def shown(raw: bytes) -> str:
    """An injective text form of raw bytes: backslashes doubled, bad bytes ``\\xNN``, unprintable letters ``\\u{XXXX}``."""
    out = []
    for c in raw.decode("utf-8", "surrogateescape"):
        code = ord(c)
        if c == "\\":
            out.append("\\\\")
        elif 0xDC80 <= code <= 0xDCFF:
            out.append(f"\\x{code - 0xDC00:02X}")
        elif c.isprintable():
            out.append(c)
        else:
            out.append(f"\\u{{{code:04X}}}")
    return "".join(out)


@F.pandas_udf(StringType())
def display_name(raw: pd.Series) -> pd.Series:
    return raw.map(lambda b: None if b is None else shown(bytes(b)))


@F.pandas_udf(StringType())
def zip_member_name(raw: pd.Series) -> pd.Series:
    """As ``display_name``; a component of the path that is not UTF-8 is read as code page 850."""

    def component(b: bytes) -> bytes:
        try:
            b.decode()
        except UnicodeDecodeError:
            return b.decode("cp850").encode()
        return b

    def one(b: bytes | None) -> str | None:
        return None if b is None else shown(b"/".join(map(component, bytes(b).split(b"/"))))

    return raw.map(one)


def preview_text(raw: bytes, most: int) -> tuple[str, str]:
    """Encoding and text of the first ``most`` bytes: by byte-order mark, else UTF-8 if valid, else windows-1252.

    A character that the cap cuts is left out; bytes that an encoding lacks
    become the replacement character.
    """
    b, cut = raw[:most], len(raw) > most
    for mark, encoding in ((b"\xef\xbb\xbf", "UTF-8"), (b"\xff\xfe", "UTF-16LE"), (b"\xfe\xff", "UTF-16BE")):
        if b.startswith(mark):
            return encoding, codecs.getincrementaldecoder(encoding)("replace").decode(b[len(mark) :], not cut)
    try:
        return "UTF-8", codecs.getincrementaldecoder("utf-8")("strict").decode(b, not cut)
    except UnicodeDecodeError:
        return "windows-1252", b.decode("cp1252", "replace")
