"""Message text: escaping, masking, host and program names, patterns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_LATIN = "ISO-8859-1"
# Optional PRI, month, day and hour:minute:second, when a word follows.
_DATED_HEAD = r"^(?:<[0-9]+>)?\s*\S{1,3}\s*[0-9]+\s*[0-9]+:\s*[0-9]+:\s*[0-9]+\s+(?=\S)"
_WORD = r"^\s*\S+\s*"
_BLANKS = " \t\n\r\f\x0b"


def flatten_newlines(text: Column) -> Column:
    return F.replace(text, F.lit("\n"), F.lit(" "))


def show_controls(flat: Column) -> Column:
    """Control characters to ``^X``, DEL and C1 to ``\\ooo``.

    Most lines have none and are only looked at. The others are gone through a
    few times: what stands before the last character of each sign is put in
    front of the control characters, by ranges that share it, then these turn into that last
    character all at once. This stands in a lambda, which keeps it out of the generated code.
    """
    low = [chr(c) for c in range(1, 32)]
    high = [chr(c) for c in range(127, 160)]
    last = "".join(chr(ord(c) + 64) for c in low) + "".join(format(ord(c), "03o")[-1] for c in high)

    def replaced(text: Column) -> Column:
        text = F.regexp_replace(text, "(?=[\\x01-\\x1f])", "^")
        text = F.regexp_replace(text, "(?=\\x7f)", "\\\\17")
        for first in range(128, 160, 8):
            text = F.regexp_replace(text, f"(?=[\\x{first:02x}-\\x{first + 7:02x}])", "\\\\" + format(first, "03o")[:2])
        return F.translate(text, "".join(low + high), last)

    return (F.when(flat.rlike("[\\x01-\\x1f\\x7f-\\x9f]"),
                   F.transform(F.array(flat), replaced)[0]).otherwise(flat))


def escape_controls(text: Column, strict_bytes: bool = False) -> Column:
    """Newline to blank and control characters made visible.

    With ``strict_bytes`` every UTF-8 byte is looked at on its own, so
    continuation bytes 0x80 to 0x9F are escaped as well; the lead byte stays,
    and the result need not be valid UTF-8.
    """
    flat = flatten_newlines(text)
    if not strict_bytes:
        return show_controls(flat)
    latin = F.decode(F.encode(flat, "UTF-8"), _LATIN)
    return F.encode(show_controls(latin), _LATIN).cast("string")


def mask_nonprint(text: Column) -> Column:
    """Every byte that is not printable ASCII, except newline, becomes ``X``."""
    latin = F.decode(F.encode(text, "UTF-8"), _LATIN)
    return (F.when(text.rlike("[^\\x20-\\x7e\\n]"),
                   F.regexp_replace(latin, "[^\\x20-\\x7e\\n]", "X")).otherwise(text))


def dated_head(line: Column) -> Column:
    """PRI and date in front of a host, empty when the line has none."""
    return F.regexp_extract(line, _DATED_HEAD, 0)


def first_word(tail: Column) -> Column:
    """The leading word with the blanks around it."""
    return F.regexp_extract(tail, _WORD, 0)


def strip_blanks(word: Column) -> Column:
    return F.btrim(word, F.lit(_BLANKS))


def after(text: Column, head: Column) -> Column:
    """What follows ``head`` in ``text``."""
    return F.substr(text, F.length(head) + 1)


def short_host(host: Column) -> Column:
    return F.substring_index(host, ".", 1)


def program_of(msg: Column) -> Column:
    """Leading alphanumeric run of a message."""
    return F.regexp_extract(msg, "^[0-9A-Za-z]*", 0)


def sql_escape(msg: Column) -> Column:
    """Backslash before quotes, backslash, CR, LF and DEL; for text exports only."""
    return F.regexp_replace(msg, "(['\"\\\\\\n\\r\\x7f])", "\\\\$1")


def log_name(path: Column) -> Column:
    """Default chain name of a log file: slashes become dots."""
    return F.translate(path, "/", ".")


def substitute(msg: Column, pattern: str, replacement: str) -> Column:
    """Replace every match of ``pattern``; ``$1`` names a group."""
    return F.regexp_replace(msg, pattern, replacement)


def to_hex(data: Column) -> Column:
    return F.lower(F.hex(data))


def from_hex(text: Column) -> Column:
    return F.unhex(text)
